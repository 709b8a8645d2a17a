"""Tokenizer, splitting and leakage against exact round trips and brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import leakage, splitting, tokenization

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokenization.TOKENIZER_DIR), reason="no tokenizer files")
TOK = None


def tok():
    return tokenization.tokenizer()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_round_trip(text):
    ids = tok().encode(text)
    assert tok().decode_bytes(ids).decode("utf-8", "replace") == text.encode("utf-8", "replace").decode()


def test_safe_parts_change_nothing():
    rng = random.Random(1)
    text = "".join(rng.choice("ab1 \n\t.한日's　 ") for _ in range(30_000))
    whole = tok()._core.encode_ordinary(text)
    parts = [i for p in tokenization.safe_parts(text, 500) for i in tok()._core.encode_ordinary(p)]
    assert parts == whole and sum(1 for _ in tokenization.safe_parts(text, 500)) > 20


def test_encode_column(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "한국어 テスト \u0000 x"), (5, "a" * 200_000), (6, "<|endoftext|>"), (1, "hello world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("__text", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in tokenization.encode_column(df, "doc_id", "text").collect()}
    assert got[1] == [31373, 995] and got[2] == [] and got[3] == [] and len(got[6]) > 1
    assert tok().decode_bytes(got[4]).decode() == rows[3][1] and tok().decode_bytes(got[5]).decode() == rows[4][1]
    assert tokenization.encode_column(df.limit(0), "doc_id", "text").count() == 0


SHAPES = {
    "prose": " ".join(f"Sentence number {i} tells about the queue and the store." for i in range(400)),
    "headings": "\n\n".join(f"## Part {i}\n\nwords about topic{i % 7} " * 6 for i in range(120)),
    "one run": "a" * 30_000,
    "hangul run": "가나다라" * 3000,
    "japanese": "これは長い文章です。次の文もあります。" * 700,
    "blank": " " * 30_000,
    "odd spaces": "\u3000a\u00a0b" * 6000,
    "signs": "。あ！い" * 3000,
    "lines": "\r\n".join(["x = 1", "", "y = f(x)"] * 900),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("limit, overlap", [(1024, 64), (128, 16)])
def test_pieces_hold_everything(name, limit, overlap):
    text = SHAPES[name]
    raw, pieces = text.encode(), splitting.cut(tok(), text, limit, overlap)
    back = b""
    for start, end, size, repeated in pieces:
        assert start + repeated == len(back) and end > len(back)
        assert size == len(tok().encode(raw[start:end].decode())) <= limit
        back += raw[start + repeated : end]
    assert back == raw and len(pieces) > 1


def test_cuts_stand_at_boundaries():
    text = SHAPES["headings"]
    raw = text.encode()
    ends = [re.match(rb"\s*", raw[e:])[0] for _, e, _, _ in splitting.cut(tok(), text)[:-1]]
    assert all(ends) and sum(b"\n\n" in e for e in ends) >= len(ends) * 0.8


def test_split_oversized(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, SHAPES["prose"]), (4, SHAPES["prose"]), (5, "x " * 1024)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_oversized(df, "doc_id", "text").collect()
    by = {k: [r for r in got if r["doc_id"] == k] for k in range(1, 6)}
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and len(by[3]) == 1 and len(by[4]) % 2 == 0
    only = splitting.split_oversized(df, "doc_id", "text", with_text=False, oversized_only=True).filter("pieces > 1").select("doc_id").distinct().collect()
    want = {k for k, t in rows if t and len(tok().encode(t)) > 1024}
    assert {r[0] for r in only} == want
    assert splitting.split_oversized(df.limit(0), "doc_id", "text").count() == 0


def brute_leaks(docs, items, n=13):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    index = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - n + 1):
            index.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            out |= {(d, k) for k in index.get(tuple(w[i : i + n]), ())}
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(30)] + [(90, None), (91, "")]
    items.append((92, items[3][1]))  # two items that share everything
    docs = [(0, None), (1, ""), (2, "few words")]
    for d in range(3, 120):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if d % 2:
            source = rng.choice(items[:30])[1].split()
            a = rng.randrange(0, max(1, len(source) - 12))
            part = source[a : a + rng.choice([11, 12, 13, 14, 30])]
            if d % 3 == 0:
                part = [w.upper() + rng.choice([",", "\n// ", " — ", "_", " "]) for w in part]
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = part
        docs.append((d, " ".join(body)))
    docs += docs[5:9]
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.leaked_passages(ddf, "doc_id", "text", idf, "item_id", "text")
    got = [(r["doc_id"], r["item_id"]) for r in found.filter("longest_run >= 13").collect()]
    want = brute_leaks(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert leakage.leaked_passages(ddf, "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked_passages(ddf.limit(0), "doc_id", "text", idf, "item_id", "text").count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    text = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(4)]
    docs = spark.createDataFrame([(i, "pre " + t + " post") for i, t in enumerate(text)], "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(text)), "item_id bigint, text string")
    got = leakage.leaked_passages(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert sorted((r[0], r[1], r["longest_run"]) for r in got) == [(i, i, 15) for i in range(4)]


def test_hamming_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    queries = np.concatenate([stored ^ (np.uint64(1) << np.uint64(rng.integers(63))) ^ (np.uint64(1) << np.uint64(rng.integers(63))), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    q, s = leakage.HammingIndex(stored, 2).within(queries)
    want = {(i, j) for i in range(len(queries)) for j in range(200) if bin(int(queries[i] ^ stored[j])).count("1") <= 2}
    assert set(zip(q.tolist(), s.tolist())) == want and len(want) >= 200


LONG = {"run": "ab" * 500_000, "no spaces": "これは長い文章です" * 100_000, "spaces": " " * 1_000_000, "dashes": "a-" * 500_000, "calls": "a(b" * 300_000, "values": "f(" + "a=b," * 250_000, "tags": "<a-b " * 200_000, "slashes": "/" * 1_000_000, "underscores": "a_" * 500_000, "mail": "a.b+" * 250_000 + "@", "digits": "key: " + "1" * 1_000_000 + " word", "sentences": "A short one. " * 80_000}


@pytest.mark.parametrize("name", LONG)
def test_languages_of_long_runs_in_linear_time(name):
    import time

    from corpusloom.llm import language

    began = time.process_time()
    language.segments(LONG[name])
    assert time.process_time() - began < 5


def test_other_languages_saving_and_rejection(tmp_path):
    import random

    import numpy as np

    from corpusloom.llm import language

    rng = random.Random(3)
    words = {"en": "the queue is empty while a writer holds its lock and nobody reads".split(), "de": "die Schlange ist leer während ein Schreiber seine Sperre hält und niemand liest".split(), "es": "la cola está vacía mientras un escritor mantiene su cierre y nadie lee".split()}
    rows = [(" ".join(rng.sample(words[code], 7)), code) for code in words for _ in range(400)]
    model = language.train(rows)
    assert language.text_languages(model, "the writer holds a lock and nobody reads")[0][1] == "en"
    assert language.text_languages(model, "zondag gaan wij allemaal samen fietsen langs het kanaal")[0][1] == language.OTHER
    model.save(str(tmp_path / "m.npz"))
    again = language.LanguageModel.load(str(tmp_path / "m.npz"))
    for text, _ in rows[::50]:
        assert language.text_languages(again, text) == language.text_languages(model, text)
    sure = np.linspace(0.2, 1, 1000)
    assert 0.35 < language.rejection(sure, sure > 0.4) < 0.45 and language.rejection(sure, sure > 0) == sure.min()


def test_long_texts_keep_memory_bounded():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words, items = rng.integers(1, 1 << 40, 3_000_000), [rng.integers(1, 1 << 40, n) for n in (40, 13, 300)]
    for at, item in zip((249_990, 1_000_000, 2_499_900), items):
        words[at : at + len(item)] = item
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.ListArray.from_arrays(pa.array([0, len(words), len(words) + 20], pa.int32()), pa.array(np.r_[words, items[0][:20]]))], names=["d", "w"])
    tracemalloc.start()
    found = [r for b in leakage._scanner([(i, w.tolist()) for i, w in enumerate(items)], "d", "i", leakage.WINDOW, leakage.RADIUS)(iter([batch])) for r in b.to_pylist()]
    best = {}
    for r in found:
        best[r["d"], r["i"]] = max(best.get((r["d"], r["i"]), 0), r["longest_run"])
    assert {k: v for k, v in best.items() if v} == {(7, 0): 40, (7, 1): 13, (7, 2): 300, (8, 0): 20}
    depths = splitting.valley_depths(rng.integers(0, 50_000, 1_000_000))
    assert len(depths) == 1_000_000 // splitting.CELL + 2 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_depths_do_not_depend_on_parts(monkeypatch):
    import numpy as np

    ids = np.random.default_rng(2).integers(0, 300, 5_000)
    whole = splitting.valley_depths(ids)
    monkeypatch.setattr(splitting, "CELLS_AT_ONCE", 17)
    assert np.allclose(whole, splitting.valley_depths(ids), atol=1e-5)
