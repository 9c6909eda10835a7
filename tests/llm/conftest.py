"""Small tables with null, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = {"en": "the of and thing with over under house river stone green morning letter window garden".split(), "fr": "le la des une avec sous maison rivière pierre vert matin lettre fenêtre jardin être".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n))


def make_documents(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        rows.append([i, prose(rng, lang, rng.randint(4, 120)), lang, f"src{min(i % 7, 3)}"])
    for i in range(0, 40, 4):
        rows[i + 100][1] = rows[i][1]  # exact copies
    for i in range(1, 40, 4):
        w = (rows[i][1] + " " + prose(rng, "en", 90)).split()
        rows[i][1] = " ".join(w)
        w[len(w) // 2] = "changed"
        rows[i + 120][1] = " ".join(w)  # near copies
    for i in range(0, n, 9):
        rows[i][1] += " call +1 (555) 123-45" + str(10 + i % 80) + f" or write me{i}@mail{i % 3}.example.com from 10.0.{i % 300}.7 now, 4111 1111 1111 1111."
    rows += [[n, None, "en", "src0"], [n + 1, "", "fr", None], [n + 2, " \n\t ", None, "src1"], [n + 3, "12 345 !!", "en", "src1"], [n + 4, "one two", "en", ""], [n + 5, "one two", "en", ""], [n + 6, "Ünï 😀 " * 5, "de", "src2"]]
    rows.append([n + 7, prose(rng, "en", 60_000), "en", "src0"])  # very long
    rows.append([n + 8, "x" * 200_000, "en", "src0"])
    rows += [list(rows[3]), list(rows[3])]  # repeated rows
    rows.append([None, "a row without an id but with words", "en", "src0"])
    return rows


def write(folder, documents):
    ids = [r[0] for r in documents]
    n = len(ids)
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array([r[1] for r in documents], pa.string()), "lang": pa.array([r[2] for r in documents], pa.string()), "source": pa.array([r[3] for r in documents], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in documents], pa.int64())}
    table |= {k: pa.array([k] * n, pa.string()) for k in ("score", "c", "row", "item", "toxic", "start", "target", "text_hash", "h", "g")}
    pq.write_table(pa.table(table), f"{folder}/documents.parquet")
    known = [i for i in ids if i is not None]
    toxic = [i for i in known if i % 5 == 2]
    pq.write_table(pa.table({"doc_id": pa.array(known, pa.int64()), "quality": pa.array([1] * len(known), pa.int32()), "toxic": pa.array([int(i in toxic) for i in known], pa.int32()), "text": pa.array(["clash"] * len(known))}), f"{folder}/labels.parquet")
    pages = ["<html><body><nav>menu</nav><article><h1>T</h1><p>one  two<p>three &amp; four</article><footer>f</footer></body></html>", None, "", "<p>no main here, but a long enough line of text to read</p>"] * (1 if n else 0)
    pq.write_table(pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": pa.array([f"http://a/{i}" for i in range(len(pages))], pa.string()), "html": pa.array(pages, pa.string()), "text": pa.array(["clash"] * len(pages), pa.string())}), f"{folder}/pages.parquet")
    items = [r[1] for r in documents if r[0] is not None and r[0] in (7, 11)][:2] + [None, "", "too few"] * (1 if n else 0)
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), f"{folder}/benchmark.parquet")


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def edge(tmp_path_factory, documents):
    folder = tmp_path_factory.mktemp("edge")
    write(folder, documents)
    return str(folder)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write(folder, [])
    return str(folder)
