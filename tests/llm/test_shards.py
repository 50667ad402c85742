"""Exact repeats, collocations and the filter audit against brute force and SQL, on odd tables and small shards."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from vigilake.llm import audit, collocations, exact_repeats, suffixes, terms
from vigilake.llm.common import unpacked

SF = "/root/testdata/sf0.001"


def test_suffix_array_and_repeats_equal_sorting():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 26, 256])
        pieces = [bytes(rng.randrange(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 8))]
        t, raw, rest = suffixes.joined(pieces)
        array = suffixes.suffix_array(t)
        assert array.tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:].tolist()))
        length, places, at = rng.randrange(1, 20), {}, 0
        lcp, previous = suffixes.permuted_lcp(t, raw, rest, array, length)
        for i in range(len(t)):
            p, shared = previous[i], 0
            while p != i and shared < min(rest[i], rest[p]) and t[i + shared] == t[p + shared]:
                shared += 1
            assert lcp[i] == shared or max(lcp[i], shared) < length or p == i
        for piece in pieces:
            for i in range(len(piece) - length + 1):
                places.setdefault(piece[i : i + length], []).append(at + i)
            at += len(piece) + 1
        want = {i for same in places.values() if len(same) > 1 for i in same}
        assert set(np.flatnonzero(suffixes.repeated(pieces, length)).tolist()) == want


def kept_by_brute_force(texts, length):
    seen = {}
    for data in texts:
        for i in range(len(data) - length + 1):
            window = hash(data[i : i + length]), data[i : i + 8]
            seen[window] = seen.get(window, 0) + 1
    out = []
    for data in texts:
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[hash(data[i : i + length]), data[i : i + 8]] > 1:
                covered[i : i + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(45)
    texts = [prose(80) + passage + prose(20) for _ in range(30)]  # a hot passage between different texts
    texts += [passage[20:] + other, other + other, prose(200), prose(3), "", None, "a" * 900, "ab" * 300, "x" * 199, "y" * 200, "y" * 200]
    base = prose(300).split(" ")
    for k in range(8):  # near copies
        base[k * 37] = word()
        texts.append(" ".join(base))
    texts += [texts[3]] * 5
    long = prose(40_000)
    texts += [long, prose(30) + long[100_000:160_000]]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("hot", "shard_bytes"), [(2000, 4 << 20), (3, 2000)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, shard_bytes):
    monkeypatch.setattr(exact_repeats, "BLOCK", 70_000)
    rows = repeat_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = exact_repeats.remove_repeats(docs, hot=hot, shard_bytes=shard_bytes).collect()
    want = kept_by_brute_force([(t or "").encode() for _, t in rows], 200)
    key = lambda x: (str(x[0]), *x[1:])
    expected = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__kept_sha256"]) for r in got), key=key) == expected
    for r in got:
        assert r["__kept"] is None and not r["__n_removed"] or hashlib.sha256(r["__kept"]).hexdigest() == r["__kept_sha256"]


def test_repeats_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in driver.queries()["op11_exact_repeats"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = kept_by_brute_force([(d.text or "").encode() for d in docs], 200)
    assert got == {d.doc_id: w for d, w in zip(docs, want, strict=True)}
    assert sum(w[1] for w in want) > 10_000


def test_repeats_carry_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id bigint, text string, rid bigint")
    row = exact_repeats.remove_repeats(docs).first()
    assert (row.rid, row["__n_bytes"], row["__n_removed"]) == (2, 1, 0)
    assert exact_repeats.remove_repeats(docs.where("doc_id > 5")).count() == 0
    clash = exact_repeats.remove_repeats(docs.withColumnRenamed("rid", "__kept_sha256").withColumn("runs", F.lit("mine")))
    assert clash.first()["runs"] == "mine" and clash.first()["__kept_sha256"] == hashlib.sha256(b"x").hexdigest()


ODD = [
    (1, "In the end, of the end. the END of it", "en", 0), (2, None, None, 0), (3, "", "en", 0), (None, " \t\n", "de", 0), (4, "a.b;c", None, 0), (4, "a.b;c", None, 0),
    (5, "x " * 300_000, "en", 0), (6, "Ünd der ende der ende der", "de", 0), (7, "$ A B C", "", 0), (8, "$ A B C", "en", 0), (None, "$ A B C", "en", 0),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, part int").repartition(3)


def same_as_sql(spark, got, sql, rows=ODD, labels=()):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, part INT)")
    con.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    for name, values in (("documents", rows), ("labels", labels)):
        if values:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
    want = con.sql(sql)
    places = [got.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in places) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 50, "bucket_bytes": 100, "bucket_rows": 5, "split_rows": 3}])
def test_collocations_equal_sql_whatever_the_sizes(spark, sizes):
    rows = ODD + [(10 + i, f"of the end {'very ' * (i % 5)}good. the end of it is {i % 3} good", "en", 0) for i in range(40)]
    docs = odd(spark, rows)
    got = collocations.collocations(docs.drop("part"), support=2, **sizes).withColumnRenamed("part", "lang")
    same_as_sql(spark, got, collocations.op12_sql(support=2), rows)
    assert collocations.collocations(docs.where("doc_id > 99")).count() == 0


def test_windows_equal_counting():
    rng = np.random.default_rng(3)
    for size in (3, 70_000):
        local = np.append(0, rng.integers(0, size + 1, 50))
        tokens = rng.integers(0, 51, 500).astype(np.int32)
        want = {}
        w = [int(local[t]) for t in tokens] + [0] * 3
        for i in range(500):
            if w[i] and w[i + 1]:
                key = (w[i], w[i + 1], w[i + 2], w[i + 3] if w[i + 2] else 0)
                want[key] = want.get(key, 0) + 1
        *words, n = collocations.windows(tokens, local, size)
        assert dict(zip(zip(*(x.tolist() for x in words), strict=True), n.tolist(), strict=True)) == want


def test_audit_equals_sql_on_odd_rows(spark):
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, 0), (7, None, 1), (None, 1, 1)]
    rows = [r for r in ODD if r[0] is not None]
    classes = audit.with_labels(audit.failures(odd(spark, rows)), spark.createDataFrame([x for x in labels if x[0] != 5], "doc_id bigint, quality int, toxic int"))
    same_as_sql(spark, audit.interactions(classes), audit.op13_sql(), rows, [x for x in labels if x[0] != 5])
    # Several labels of one document, rows without key, and repeats.
    found = {(r.key, r.part, r.fails, r.n) for r in audit.failures(odd(spark)).collect()}
    assert (None, "en", "ACDE", 1) in found and (4, "", "A", 2) in found and (7, "", "ACD", 1) in found and (8, "en", "ACDE", 1) in found
    many = audit.with_labels(audit.failures(odd(spark)), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert many.where("good and toxic").count() == 1 and audit.interactions(many.where("false")).count() == 0
    assert audit.failures(odd(spark).where("doc_id > 99")).count() == 0


def test_matrix_has_one_number_for_a_word_in_all_shards(spark):
    docs = odd(spark).withColumnRenamed("part", "shard")
    matrix, dictionary = terms.term_matrix(docs, shard_bytes=20, bucket_bytes=10)
    words = {r.term_id: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(set(words.values())) == len(words)
    found = []
    for r in matrix.collect():
        indptr, indices, counts = (unpacked(bytes(r[c]), t) for c, t in (("indptr", "<i4"), ("indices", "<i8"), ("counts", "<i4")))
        for label, a, b in zip(r.labels, indptr[:-1], indptr[1:], strict=True):
            found.append((str(label.doc_id), sorted((words[i], int(n)) for i, n in zip(indices[a:b].tolist(), counts[a:b], strict=True))))
    want = []
    for key, text, *_ in ODD:
        words_of = (text or "").split()
        want.append((str(key), sorted((w, words_of.count(w)) for w in set(words_of))))
    assert sorted(found) == sorted(want)
