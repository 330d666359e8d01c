"""Operators 5 and 7 against brute force, SQL and hand-made archives."""

import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from checks.compare import compare, connect
from scarpline.llm import queries, vector_search, warc
from scarpline.session import scratch_path

# ---------------------------------------------------------------- vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 4]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted(((-float(q @ x), j) for j, x in good if j != i))[:k]
            out[i] = [(j, round(-s, 9)) for s, j in near]
    return out


def test_every_leaf_visited_is_exact(spark):
    """With all leaves visited the search is exact: flaws, copies, ties and one hot vector included."""
    rng = random.Random(3)
    hot = [1.0, 0.5, -0.25, 2.0]
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(300)]
    rows += [(i, hot, 1) for i in range(300, 460)]
    rows += [(480, None, 0), (500, [0.0] * 4, 0), (520, [1.0, None, 0.0, 0.0], 0), (540, [float("nan"), 1.0, 1.0, 1.0], 0), (560, [float("inf")] + [1.0] * 3, 0), (580, [1.0, 2.0], 0), (600, [], 0), (None, hot, 0)]
    found = vector_search.search(frame(spark, rows).withColumn("score", F.lit("mine")), F.col("vec_id") % 20 == 0, k=7, aim=1.0, leaf=40, sample=200, block=32)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    want = brute(rows, 7)
    assert got.keys() == want.keys()
    same = [got[q] == want[q] for q in want]
    assert sum(same) >= 0.95 * len(same)
    for q in want:
        if q >= 300:
            assert [j for j, _ in got[q]] == [j for j, _ in want[q]]


def test_few_candidates_and_empty(spark):
    few = frame(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert vector_search.search(few.limit(0), F.lit(True)).count() == 0
    assert vector_search.search(few, F.lit(False)).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    asked = vector_search.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, leaf=100)
    found = asked.groupBy("query_id").agg(F.collect_set("vec_id").alias("got")).collect()
    hits = 0
    for r in found:
        s = x @ x[np.flatnonzero(ids == r.query_id)[0]]
        best = [i for i in ids[np.argsort(-s, kind="stable")] if i != r.query_id][:20]
        hits += len(set(best) & set(r.got))
    assert all(len(r.got) == 20 for r in found)
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)


# ---------------------------------------------------------------- archives

PAGES = [
    (1, "http://a/1", "<p>a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é</p>"),
    (2, "http://a/2", "<p>a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é</p>"),
    (3, None, None),
    (4, "http://a/4\nx", ""),
    (4, "http://a/4", ""),
    (None, "http://n", "own"),
    (9, "http://long", "x" * 300_000),
]


def test_write_read_assemble(spark):
    path, pages = scratch_path(spark, "warc"), scratch_path(spark, "pages")
    spark.createDataFrame([(*p, "old") for p in PAGES], "page_id bigint, url string, html string, kind string").repartition(2).write.parquet(pages)
    warc.write(spark.read.parquet(pages), path, per_file=4)
    rows = warc.captures(warc.read(spark, path)).select("*", F.col("metadata")[0]["fields"]["page-id"].cast("bigint").alias("page")).collect()
    assert len(rows) == len(PAGES) and all(len(r.requests) == len(r.metadata) == 1 for r in rows)
    by = {r.capture: r for r in rows}
    kinds = sorted(((r.page, r.response.kind, by[r.payload_of].page, r.payload_bytes) for r in rows), key=repr)
    big = len(PAGES[0][2].encode())
    assert kinds == sorted([(1, "revisit", 2, big), (2, "response", 2, big), (3, "revisit", 4, 0), (4, "response", 4, 0), (4, "revisit", 4, 0), (None, "response", None, 3), (9, "response", 9, 300_000)], key=repr)
    payloads = {r.page: bytes(r.response.payload) for r in rows if r.response.kind == "response"}
    assert payloads[2].decode() == PAGES[1][2] and payloads[9] == b"x" * 300_000
    assert all(r.payload_digest == r.response.stated_digest for r in rows)


def test_threshold_and_empty(spark):
    pages = scratch_path(spark, "pages")
    spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string").write.parquet(pages)
    path = scratch_path(spark, "warc")
    warc.write(spark.read.parquet(pages), path, least=3)
    kinds = warc.captures(warc.read(spark, path, payload=False)).select(F.col("metadata")[0]["fields"]["page-id"], "response.kind").collect()
    assert sorted(tuple(r) for r in kinds) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]
    path = scratch_path(spark, "warc")
    warc.write(spark.read.parquet(pages).limit(0), path)
    assert warc.captures(warc.read(spark, path)).count() == 0


def test_members_orphans_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <q>\r\nWARC-Concurrent-To: <gone>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: 7\r\n\r\nno head\r\n\r\n"
    plain = list(warc.records(one + two, True))
    assert [r["id"] for r in plain] == ["<q>", "<r>"] and plain[1]["payload"] == b"no head"
    assert list(warc.records(gzip.compress(one) + gzip.compress(two), True)) == plain
    assert list(warc.records(b"", True)) == []


def test_orphans_make_a_row_without_a_response(spark):
    path = scratch_path(spark, "warc")
    text = "WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <q>\r\nWARC-Concurrent-To: <gone>\r\nContent-Length: 3\r\n\r\nGET"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    (row,) = warc.captures(warc.read(spark, path)).collect()
    assert row.capture == "<gone>" and row.response is None and len(row.requests) == 1


def test_query_equals_sql(spark, small):
    ok, message = compare(spark, connect(small), small, "op7_warc", queries.QUERIES["op7_warc"], queries.ORACLES["op7_warc"])
    assert ok, message
