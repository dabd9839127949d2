from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa

from tessera.llm import langid, packing
from tessera.llm.common import table

from .brute import docs_frame

ROWS = [(5, "a b  c\n"), (None, " lead"), (1, None), (2, ""), (5, "a b  c\n"), (9, "x " * 5000), (3, "one"), (4, "t " * 8), (7, "é ß\tñ ")]


def test_packing_against_sql_and_round_trip(spark):
    docs = docs_frame(spark, ROWS, extra=True)
    got = packing.pack(docs).toArrow()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    want = duckdb.sql(packing.SQL).to_arrow_table()
    names = ["doc_id", "piece", "start", "length", "place", "batch", "text"]

    def rows(t, *drop):
        return sorted((tuple(repr(r[c]) for c in names if c not in drop) for r in t.to_pylist()))

    # repeated rows: SQL numbers the pieces of both together
    assert rows(got, "piece", "place", "batch") == rows(want, "piece", "place", "batch")
    for k in {r["length"] for r in got.to_pylist()}:
        assert k & (k - 1) == 0 and k <= packing.MAX_LENGTH
        assert sorted(r["place"] for r in got.to_pylist() if r["length"] == k) == list(range(sum(r["length"] == k for r in got.to_pylist())))
    whole: dict = {}
    for r in sorted(got.to_pylist(), key=lambda r: r["start"]):
        if r["doc_id"] != 5:
            whole[r["doc_id"]] = whole.get(r["doc_id"], "") + r["text"]
    assert whole == {i: t for i, t in ROWS if t and i != 5}
    assert packing.pack(docs_frame(spark, [])).count() == 0


def test_places_in_many_runs(spark, monkeypatch):
    """Hashed ids, a third of the rows without an id, and repeated rows: in runs of a few rows the places are those of one order."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(-(1 << 62), 1 << 62)), "a " * int(rng.integers(1, 40))) for _ in range(150)]
    rows += [(None, f"{'bcd'[k % 3]}{k % 40} " * int(rng.integers(1, 30))) for k in range(100)] + [(7, "same text ")] * 40
    docs = docs_frame(spark, rows).repartition(7)
    got = packing.pack(docs, run=16).toArrow()
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    want = duckdb.sql(packing.SQL).to_arrow_table()
    names = ["doc_id", "start", "length", "place", "batch", "text"]
    assert sorted(tuple(repr(r[c]) for c in names) for r in got.to_pylist()) == sorted(tuple(repr(r[c]) for c in names) for r in want.to_pylist())
    sizes = spark.createDataFrame([(None if i is None else i, t[:8]) for i, t in rows], "doc_id long, letters string")
    numbers, ends = packing._bounds(sizes, 16)
    assert len(ends) > 10 and sum(e[0] == packing._NONE for e in ends) >= 4  # rows without an id are cut too


def test_language_bundles_against_plain_python():
    texts = ["Ab c", "", "été, 12 a", "zz" * 40]
    vector = {}

    def letter(c):
        if c not in vector:
            vector[c] = langid.letter_vectors(np.array([ord(c) if c != " " else 0], np.uint32))[0].astype(int)
        return vector[c]

    for i, j, got in langid.vectors(pa.array(texts)):
        for k in range(i, j):
            t = "".join(c if c.isalpha() else " " for c in texts[k].lower())
            t = " " + " ".join(t.split()) + " " if t.strip() else ""
            want = np.zeros(langid.DIMENSIONS)
            for a, b, c in zip(t, t[1:], t[2:], strict=False):
                want += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
            assert np.allclose(got[k - i], want)


def test_language_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train, held = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    got = langid.identify(held, langid.prototypes(train)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.95


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "plain text"), (4, "ab " * 50000), (5, "same"), (5, "same")]
    got = langid.identify(docs_frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows) and [r["language"] for r in got if r["doc_id"] in (1, 2, 3)] == [None] * 3
    assert all(r["language"] == "en" for r in got if r["doc_id"] in (4, 5, None))
    assert langid.identify(docs_frame(spark, [])).count() == 0
