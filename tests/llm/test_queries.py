"""Each query over the edge-case tables against a brute-force version, and over empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import common, decontaminate, fingerprint, html_extract, language_id, line_dedup, mixing, ngram_join, pii, registry, token_pack, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_language(spark, edge, documents):
    rows = {r["doc_id"]: r for r in language_id.op1_language_id(spark, edge).collect()}
    assert len(rows) == len({r[0] for r in documents})
    right = total = 0
    for i, text, lang, _ in documents:
        r = rows[i]
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (i is None or crc(i) % 3 == 1)
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and lang in ("en", "fr") and len(text) > 30:
            total += 1
            right += r["lang_pred"] == lang
    assert right >= 0.95 * total > 0


def test_code_lengths_are_those_of_a_plain_tree():
    texts, langs = [b"abracadabra", b"banana band", b"zebra"], ["x", "x", "y"]
    model = language_id.fit(texts, langs)

    def plain(train, history, byte):
        """PPM with full exclusion, from definitions."""
        known = sorted({b for t in texts for b in t})
        p_up = {b: 1 / 256 for b in range(256)}
        for order in range(0, min(3, len(history)) + 1):
            context = history[len(history) - order :]
            seen = Counter(t[i + order] for t in train for i in range(len(t) - order) if t[i : i + order] == context)
            exists = any(t[i : i + order] == context for u in texts for t in [u] for i in range(len(t) - order)) if order else True
            if seen and exists:
                n, d = sum(seen.values()), len(seen)
                rest = sum(p for b, p in p_up.items() if b not in seen)
                p_up = {b: seen[b] / (n + d) if b in seen else d / (n + d) * p / rest for b, p in p_up.items()}
        assert known
        return p_up[byte]

    test = b"abrabandq"
    bits = language_id.code_lengths(model, np.frombuffer(test, np.uint8), np.array([0, len(test)]))[0]
    for k, name in enumerate(model["langs"]):
        train = [t for t, lang in zip(texts, langs) if lang == name]
        want = -sum(math.log2(plain(train, test[:i], test[i])) for i in range(len(test)))
        assert bits[k] == pytest.approx(want, rel=1e-5)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(6)
    names = [f"l{k:02d}" for k in range(70)]
    vocabulary = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for x in names}
    rows = [(i, " ".join(rng.choice(vocabulary[names[i % 70]], 30)), names[i % 70]) for i in range(420)]
    model = language_id.fit_table(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == names
    import pyarrow as pa

    tests = [" ".join(rng.choice(vocabulary[x], 20)) for x in names]
    assert language_id.predict(model, pa.array(tests))[0] == names


def test_lines(spark, tmp_path):
    from .conftest import write

    block = "one line here\nanother line\na third line"
    texts = [f"start {i}\n{block}\nend {i}" for i in range(5)] + [None, "", "a\na\na\na\na", block, "\n\n\n\n", "x\n\n\n\ny", f"{block}\nfourth\nfifth", f"q\n{block}\nfourth\nfifth", "two\nlines", "two\nlines"]
    rows = [[i, t, "en", "s"] for i, t in enumerate(texts)] + [[None, f"null id\n{block}", "en", "s"], [3, texts[3], "en", "s"]]
    write(tmp_path, rows)
    want = Counter()
    seen = {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    gone = {}
    for none, i, t in order:
        lines = t.split("\n")
        cover = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w) and seen.setdefault(w, (none, i, p)) != (none, i, p):
                cover |= {p, p + 1, p + 2}
        gone[none, i, t] = cover
    for i, t, _, _ in rows:
        t = t or ""
        cover = gone[i is None, i or 0, t]
        clean = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cover)
        want[i, len(t.split("\n")), len(cover), len(clean), hashlib.sha256(clean.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["n_chars"], r["clean_sha256"]) for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect())
    assert got == want


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 8, 11, 16, 17, 24, 32):
        ids = rng.integers(0, 2**bits, 777, dtype=np.uint64).astype(np.uint32)
        raw = token_pack.pack(ids, bits)
        assert len(raw) == -(-777 * bits // 8)
        assert (token_pack.unpack(raw, bits, 0, 777) == ids).all()
        assert (token_pack.unpack(raw, bits, 123, 50) == ids[123:173]).all()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = common.default_vocabulary()
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    letters = list(" \n\t  \x85\x1c\0ab1'sé!中,.\n ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(4000)] + ["", "a" * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    encode = token_pack.Encoder(path)
    assert encode(texts) == want
    assert encode(texts) == want  # from memory


def test_tokens(spark, edge, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(common.default_vocabulary())
    rows = sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(token_pack.op3_token_packing(spark, edge).collect(), key=lambda r: r["start"])
    start = 0
    assert len(got) == len(rows)
    for (i, text, _, _), r in zip(rows, got):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_random_access(spark, edge, tmp_path):
    docs = common.table(spark, edge, "documents")
    path = str(tmp_path / "packed")
    token_pack.write(docs, path, common.default_vocabulary())
    everything = token_pack.document_ids(spark, path, 0, 1 << 40)
    assert (token_pack.document_ids(spark, path, 70_000, 1234) == everything[70_000:71_234]).all()


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_pii_spans(spark, edge, documents):
    got = pii.op4_pii(spark, edge).collect()
    assert len(got) == len(documents)
    text = {r[0]: r[1] for r in documents}
    for r in got:
        spans = base_spans(text[r["doc_id"]])
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(s[2] == k for s in spans) for k, _ in KINDS]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_pii_patterns_on_noise(spark):
    rng = np.random.default_rng(3)
    letters = list("aab..@@_%+- (1234567890+..  -é😀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["1 " * 20_000, "a" * 50_000, "a@" * 9000, "1.2.3.4 " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.base_spans(docs).select("doc_id", pii.written(pii.F.col("spans")).alias("b")).collect():
        assert r["b"] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in base_spans(texts[r["doc_id"]]))


def test_pii_terms_disclose(spark):
    texts = [f"nothing special here number {i}" for i in range(60)]
    texts[3] = texts[40] = "the zorblatt account is zed@corp.example.com for all"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    found = {texts[3][s["start"] : s["end"]] for s in rows[3]["all_spans"]}
    assert {"zorblatt", "zed@corp.example.com"} <= found
    assert not rows[5]["all_spans"]
    clean = pii.find(docs).join(docs, "doc_id").where("doc_id = 3").select(pii.sanitise(pii.F.col("text"), pii.F.col("all_spans")).alias("t")).first()["t"]
    assert "zed@" not in clean and "zorblatt" not in clean and "[EMAIL]" in clean


def test_pii_terms_disclose_at_any_distance_and_in_every_document(spark):
    texts = [f"nothing special here number {i}" for i in range(2000)]
    far = " and so on with many plain words" * 10
    for i in (3, 40):
        texts[i] = f"İ Zorblatt opens{far} mail zed@corp.example.com"  # never within 64 characters
    texts[77] = f"only the name{far} zorblatt stands here"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 3 documents have the term, 2 of them the entity: 1 - log2(3 / 2) / log2(2000 / 2) is 0.94
    rows = {r["doc_id"]: {(s["start"], s["end"]) for s in r["all_spans"]} for r in pii.find(docs).collect()}
    for i in (3, 40, 77):
        at = texts[i].lower().replace("i̇", "İ").index("zorblatt")
        assert (at, at + 8) in rows[i]
    assert not rows[5]


def test_mixing(spark, edge, documents):
    got = mixing.op5_mixing(spark, edge).collect()
    again = mixing.op5_mixing(spark, edge).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(documents)
    size = {}
    for _, text, _, source in documents:
        size[source] = size.get(source, 0) + len(words(text))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= set(over)
    text = {r[0]: (r[1], r[3]) for r in documents}
    taken, largest = Counter(), Counter()
    for r in got:
        t, source = text[r["doc_id"]]
        assert r["size"] == len(words(t))
        assert r["source_size"] == size[source]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] + 1


def test_fingerprints(spark, edge, documents):
    rows = [r for r in fingerprint.op6_fingerprints(spark, edge).collect()]
    assert len(rows) == len(documents)
    order = sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    prints = {}
    for (i, text, _, _), after in zip(order, order[1:] + order[:1]):
        text, after = text or "", after[1] or ""
        half = len(text) // 2
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    text = {r[0]: r[1] or "" for r in documents}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_fingerprint_estimate_is_near_the_similarity():
    base = [f"w{i}" for i in range(3000)]
    errors = []
    for share in (0.1, 0.5, 0.9):
        other = base[: int(3000 * share)] + [f"v{i}" for i in range(3000 - int(3000 * share))]
        data = [" ".join(base).encode(), " ".join(other).encode()]
        a, b = (fingerprint.fingerprints(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data)
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        errors.append(abs(fingerprint.likeness(a, b) - len(x & y) / len(x | y)))
    assert max(errors) < 0.12


def grams(text, k):
    w = (text or "").translate(LOWER)
    w = words(w)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i), key) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def test_join(spark, edge, documents):
    want = brute_components([(r[0], r[1]) for r in documents], 3, 90)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.op7_ngram_join(spark, edge).collect()]
    assert Counter(got) == Counter(want)
    assert len({c for _, _, c in want}) < len(want) - 15


@pytest.mark.parametrize(("k", "percent", "leaf"), [(3, 90, 1500), (5, 80, 1500), (3, 90, 8), (2, 60, 8)])
def test_join_of_dense_families(spark, monkeypatch, k, percent, leaf):
    """Families of near copies at all distances; a small leaf size makes pivots and blocks cut them over tasks."""
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    rng = np.random.default_rng(8)
    rows = []
    for family in range(4):
        base = [f"w{rng.integers(0, 5000)}" for _ in range(60 + 40 * family)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(0, len(w))] = f"x{rng.integers(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows, k, percent))


def test_join_stage_keeps_one_row_of_each_group(spark, edge, documents):
    long = " ".join(f"w{i}" for i in range(60))
    more = [[None, long, "en", "s"], [None, "another row without an id, of no group at all", "en", "s"], [7000, long + " more", "en", "s"], [7000, long + " end", "en", "s"], [7001, long, "en", "s"], [7002, "two texts of one id, the first one", "en", "s"], [7002, "and a second that is quite another", "en", "s"], [None, "null ids that repeat are one group", "en", "s"], [None, "null ids that repeat are one group", "en", "s"], [None, None, "en", "s"]]
    rows = [(r[0], r[1]) for r in documents + more]
    docs = common.table(spark, edge, "documents").select("doc_id", "text", "row", "c").union(spark.createDataFrame([(r[0], r[1], "row", "c") for r in more], "doc_id long, text string, row string, c string"))
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.stage(spark, docs, edge).collect())
    sets = [grams(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    assert sum(got.values()) == len(set(group))
    for g in set(group):
        members = [r for r, x in zip(rows, group) if x == g]
        least = min((i is None, i or 0) for i, _ in members)
        best = {r for r in members if (r[0] is None, r[0] or 0) == least}
        assert any(got[r] for r in best), members[0]
        assert len([r for r in set(members) if got[r]]) == 1


def test_components_in_rounds_and_in_one_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**62), 2**62, 400)
    edges = [(int(ids[i]), int(ids[i + 1])) for i in range(398) if i % 7] + [(int(ids[rng.integers(0, 400)]),) * 2]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r["c"]: r["f"] for r in ngram_join.connected(df).collect()}
    monkeypatch.setattr(ngram_join, "ONE_TASK_EDGES", 0)
    rounds = {r["c"]: r["f"] for r in ngram_join.connected(df).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(one) == groups(rounds) and len(groups(one)) == 57


def test_toxicity(spark, tmp_path):
    import random

    from .conftest import prose, write

    rng = random.Random(2)
    rows = [[i, prose(rng, "en", 60), "en", "s"] for i in range(900)]
    for r in rows:
        if r[0] % 5 == 2:
            w = r[1].split()
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["vileword", "nastyword"]))
            r[1] = " ".join(w)
    rows.append([900, None, "en", "s"])
    write(tmp_path, rows)
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    held = [i for i in range(900) if crc(i) % 5 == 0]
    assert all(got[i]["held_out"] == (crc(i) % 5 == 0) for i in range(900))
    assert np.mean([got[i]["predicted"] == (i % 5 == 2) for i in held]) > 0.97
    assert 0 <= got[900]["score"] <= 1
    model = toxicity.fit([r[1].encode() for r in rows[:900]], np.array([r[0] % 5 == 2 for r in rows[:900]]))
    import pyarrow as pa

    clean, misspelt = toxicity.logits(model, pa.array(["the house of green", "the vilewurd house of vilewords"]))
    assert misspelt > clean


def test_toxicity_on_edge_rows(spark, edge, documents):
    rows = toxicity.op8_toxicity(spark, edge).collect()
    assert len(rows) == len(documents)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_pages(spark, edge):
    got = {r["page_id"]: r for r in html_extract.op9_html_extraction(spark, edge).collect()}
    assert got[0]["text"] == "T\none two\nthree & four"
    assert got[1]["text"] == got[2]["text"] == ""
    assert got[3]["text"].startswith("no main here")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_furniture_is_left_out():
    page = "<body><div id=header>Site</div><div class='cookie-notice'>We use</div><div><p>Long text of the article goes on and on here.</p><p>And more of it, a second long paragraph of text.</p></div><aside>side</aside><form>f</form><section class='comments'><p>first! a long reader comment that must not be kept</p></section><div class=ad>buy</div><script>x</script></body>"
    assert html_extract.extract(page) == "Long text of the article goes on and on here.\nAnd more of it, a second long paragraph of text."
    assert html_extract.extract("<article>a&nbsp;b <i>c</i><script>no</script><br>d</article>") == "a b c\nd"


def test_the_ratio_decides_beside_an_article_too():
    body = ["A long paragraph of the real text of this page, which goes on for quite a while and says a lot. " * 3 for _ in range(6)]
    teaser = "<article>" + "".join(f"<p><a href=x><b>{w}</b></a> <i>y</i>" for w in "abcdefgh") + "</article>"
    page = f"<body><div>{''.join(f'<p>{b}</p>' for b in body)}</div>{teaser}</body>"
    assert html_extract.extract(page) == "\n".join(" ".join(b.split()) for b in body)
    page = f"<body><article><h1>T</h1>{''.join(f'<p>{b}</p>' for b in body)}</article></body>"
    assert html_extract.extract(page) == "\n".join(["T", *(" ".join(b.split()) for b in body)])


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><meta charset=utf-8><script>x</script>", "<head><noscript><link href=a>", "<head><title>t</title></head>", "<title>t</title>", "<head><template><p>no</p></template>"])
@pytest.mark.parametrize("start", ["<body>", "", "</head>"])
def test_end_tags_that_may_be_left_out(head, start):
    assert html_extract.extract(f"<html>{head}{start}<p>one<p>two <b>words</b><ul><li>three<li>four</ul>") == "one\ntwo words\nthree\nfour"
    assert html_extract.extract(f"<!DOCTYPE html>{head}{start}<article><p>one<p>two</article><footer>f</footer>") == "one\ntwo"


def test_text_ends_a_head():
    assert html_extract.extract("<head><title>t</title> \n words of the page") == "words of the page"


def tokens(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def test_decontamination(spark, edge, documents):
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.op10_decontamination(spark, edge).collect()}
    items = {0: None, 1: None}
    for i, (_, text, _, _) in enumerate([r for r in documents if r[0] in (7, 11)][:2]):
        items[i] = tokens(text)
    want = {}
    df = Counter(s for w in items.values() for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    n = 3  # items with words
    weight = {s: math.log(1 + n / c) / math.log(1 + n) for s, c in df.items()}
    for i, text, _, _ in documents:
        w = tokens(text)
        if len(w) > 5000:
            continue
        s = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for item, iw in items.items():
            t = Counter(tuple(iw[j : j + 5]) for j in range(len(iw) - 4))
            m = sum(t.values())
            total = sum(c * weight[x] for x, c in t.items())
            best = 0
            for a in range(max(1, len(s) - m + 1)):
                win = Counter(s[a : a + m])
                inter = sum(min(c, t[x]) * weight.get(x, 1) for x, c in win.items())
                own = sum(c * weight.get(x, 1) for x, c in win.items())
                best = max(best, inter / (own + total - inter)) if own else best
            if best >= 0.8:
                want[i, item] = best
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k]["similarity"] == pytest.approx(v, abs=1e-5)


def test_short_items_are_found_in_longer_documents(spark):
    docs = spark.createDataFrame([(1, "well, Blue Whale songs are long and blue whale songs are low"), (2, "blue whale songs"), (3, "blue songs of a whale in the sea"), (None, "a whale is what it was"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "blue whale songs"), (1, "Whale"), (2, ""), (3, "songs of a whale in the")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(0, 1, 1, 1, 1.0), (1, 0, 1, 3, 1.0), (1, 1, 2, 1, 1.0), (2, 0, 0, 3, 1.0), (2, 1, 1, 1, 1.0), (3, 1, 4, 1, 1.0), (3, 3, 1, 6, 1.0)]


def test_pipeline(spark, edge, documents):
    import corpus_pipeline

    docs = common.table(spark, edge, "documents")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, edge), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, edge).collect()
    assert len(packed) == docs.count()
    assert sorted(r["doc_id"] for r in packed if r["doc_id"] is not None) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
