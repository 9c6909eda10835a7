"""Words with runs of marks are composed from the word's ids and the run's, letters alone take no pattern; ids stay the library's."""

import random

from tidegauge.llm import common
from tidegauge.llm.token_pack import Encoder

PARTS = ["word", "Wörter", "l'été", "dog's", "a'll", "don't", "x1", "7", "ª", "ñandú", "日本", "हिन्दी", "éa", "\U0002ebf0\U0002ebf1", "ᲊ", "ʰx", "İi", "ß", "<|endoftext|>", "_a", "a_", "", "\t", "\0"]
MARKED = ["%%%", "***", "$$$", ".,", "...", ",,", "!?", "-", "--", "'", "'s", "'.", ".'", "\"", "°", "…", "_", "`", "a", "9", " ", "\n", "%\n", "\\", "]^", "|~"]


def test_ids_are_those_of_the_library():
    rng = random.Random(0)
    encoder = Encoder(common.default_vocabulary())
    texts = [rng.choice([" ", "", "\n"]).join(rng.choice(PARTS) + rng.choice(MARKED) * rng.randrange(2) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for i in range(0, len(texts), 64):
        assert encoder(texts[i : i + 64]) == encoder.whole(texts[i : i + 64])


def test_runs_of_marks_are_composed(monkeypatch):
    encoder = Encoder(common.default_vocabulary())
    asked = []
    joined = encoder._joined
    monkeypatch.setattr(encoder, "_joined", lambda pieces, *more: asked.extend(pieces) or joined(pieces, *more))
    texts = ["first oneableea thing", "some oneableea%%% and oneableea,, and more oneableea***"]
    assert [encoder([t])[0] for t in texts] == encoder.whole(texts)
    assert asked.count("oneableea") == 1 and not any(p.startswith("oneableea") and p != "oneableea" for p in asked)
