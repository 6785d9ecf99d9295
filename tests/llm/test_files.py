"""Token files, packing and archives: exact round trips."""

import gzip
import json
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing as P
from quillon.llm import token_files as T
from quillon.llm import warc as W
from quillon.llm.common import scratch
from quillon.llm.shared_files import open_fs, opened
from quillon.llm.tokens import encoder, public_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b\n\n c", "don't I'LL 12345", "x<|endoftext|>y", "İSTANBUL ΣΑΣ ﬁ", "é é", "tab\tx\x1cy\x85z\xa0w", "日本語 text", "😀 ok", "l'été |!! ??.", "w" * 40000, " line", "ﬀ ẞ ß"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(spark, name):
    tk, e = Tokenizer.from_file(public_path(name)), encoder(public_path(name))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for t in ODD]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        control, data = T.encode_values(v)
        assert len(control) == -(-n // 4) and (T.decode_values(control, data, n) == v).all()


def token_rows(spark, docs, **sizes):
    folder = scratch(spark, "test-qvb")
    files = T.write_token_files(docs, folder, public_path("word_bpe_49k.json"), **sizes)
    return sorted(T.read_token_files(files, folder).collect(), key=lambda r: r["start"])


def test_token_files(spark):
    tk = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = [(i * 7 % 31 if i != 5 else None, t, 0) for i, t in enumerate(ODD * 3)] + [(2**53 + 1, "a", 0), (2**53, "b", 0), (-(2**63), "c", 0), (None, "d", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    for sizes in ({}, {"file_tokens": 5000, "block_tokens": 100}):
        got = token_rows(spark, docs, **sizes)
        ids = [-(2**70) if r["doc_id"] is None else r["doc_id"] for r in got]
        assert ids == sorted(ids) and len(got) == len(rows)
        at = 0
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        want = Counter((d, np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, _ in rows)
        assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
        again = token_rows(spark, docs.repartition(3, "text"), **sizes)  # equal ids come in a fixed order
        assert [(r["doc_id"], r["start"], r["ids"]) for r in again] == [(r["doc_id"], r["start"], r["ids"]) for r in got]
    assert token_rows(spark, docs.limit(0)) == []
    with pytest.raises(TypeError):
        token_rows(spark, docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def check_packing(got, docs, longest=2048):
    e = encoder(public_path("byte_bpe_50k.json"))
    by_doc = {}
    for r in got.itertuples():
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        ids = e.encode(t or "") + np.array([1], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert not by_doc
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()]
        n = int(g["length"].sum())
        assert n <= longest
        padding += 0 if n & (n - 1) == 0 else longest - n
    return padding


def test_packing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = P.packed(spark, SF).toPandas()
    assert check_packing(got, docs) == 0
    odd = [(i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in odd], "doc_id long, text string, length int")
    for buffer in (2_000_000, 300):
        assert check_packing(P.pack_documents(frame, public_path("byte_bpe_50k.json"), buffer_tokens=buffer).toPandas(), odd) == 0
    assert P.pack_documents(frame.limit(0), public_path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(frame, public_path("byte_bpe_50k.json"), tiers=(100, 200))


def test_packing_of_equal_lengths(spark):
    """Texts that leave no short pieces are cut, so that less than a window is held back, in a run of small buffers too."""
    tiers = (256, 512, 1024, 2048)
    for lengths in ([1500] * 2000, [1300 + i % 500 for i in range(2000)], [2048] * 5, [1] * 3000, [257] * 9, [3]):
        items = [(n, i, 0) for i, n in enumerate(lengths)]
        full, rest = P.pack_buffer(items, tiers, False)
        assert sum(n for n, _, _ in rest) < 2048
        assert sum(t for t, _ in full) + sum(n for n, _, _ in rest) == sum(lengths)
        got = sorted((doc, start, n) for _, w in [*full, (0, rest)] for n, doc, start in w)
        at = {}
        for doc, start, n in got:
            assert start == at.get(doc, 0)
            at[doc] = start + n
        assert [at[i] for i in range(len(lengths))] == lengths
    docs = [(2**53 + 1 + i if i else None, "word " * 1500, 7) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, tier int").repartition(3)
    got = P.pack_documents(frame, public_path("byte_bpe_50k.json"), buffer_tokens=6000, step_tokens=8192).collect()
    assert {r["doc_id"] for r in got} == {d for d, _, _ in docs}
    n = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert all(sum(r["length"] for r in got if r["doc_id"] == d) == n[d] for d in n)
    groups = Counter()
    for r in got:
        groups[r["tier"], r["step_group"]] += r["length"]
    for t in {t for t, _ in groups}:  # over all tasks, only a tier's last group is short
        sizes = [groups[t, g] for g in sorted(g for x, g in groups if x == t)]
        assert all(x == 8192 for x in sizes[:-1]) and [g for x, g in sorted(groups) if x == t] == list(range(len(sizes)))


def test_packing_of_repeated_ids(spark):
    frame = spark.createDataFrame([("a", "x y z"), ("a", "x y z"), ("a", "other"), (None, "x"), (None, None)], "doc_id string, text string")
    got = P.pack_documents(frame, public_path("byte_bpe_50k.json")).collect()
    starts = Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert starts == {"a": 3, None: 2}


def test_tiers_are_filled():
    items = [(n, i, 0) for i, n in enumerate([1500, 700, 600, 300, 200, 200, 100, 90, 40])]
    full, rest = P.pack_buffer(items, (256, 512, 1024, 2048), False)
    assert all(sum(x[0] for x in w) == t for t, w in full) and sum(t for t, _ in full) + sum(x[0] for x in rest) == sum(x[0] for x in items)
    assert full[0][0] == 2048 and full[0][1][0][0] == 1500
    last, none = P.pack_buffer(rest, (256, 512, 1024, 2048), True)
    assert none == [] and sum(t for t, _ in last) == sum(x[0] for x in rest)


def test_warc(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "http://x/\r\nä", "päge\r\n\r\nWARC/1.1"), (5, None, None), (4, "u4", ""), (6, "u6", "z" * 300000), (7, "u7", "same")]
    pages = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, records int")
    folder = scratch(spark, "test-warc")
    raw = W.write_archives(pages, f"{folder}/raw")
    normal = W.normalize_archives(raw, f"{folder}/normal")
    got = {r["page_id"]: r for r in W.read_archives(normal, batch=2).collect()}
    assert {i: got[i]["record_type"] for i in got} == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "revisit", 6: "response", 7: "revisit"}
    assert (got[3]["refers_to"], got[5]["refers_to"], got[7]["refers_to"]) == (1, 4, 1)
    for i, _, h in rows:
        raw_bytes = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw_bytes) and got[i]["payload_digest"] == W.payload_digest(raw_bytes)
        if got[i]["record_type"] == "response":
            assert got[i]["html"] == (h or "")
    for r in normal.collect():  # each member is one record, where the index says
        with opened(r["uri"]) as f, opened(r["uri"] + ".idx") as g:
            data, lines = f.read(), [json.loads(x) for x in g.read().splitlines()]
        assert sum(x["length"] for x in lines) == len(data) and len(lines) == r["records"]
        for x in lines:
            assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
    assert W.read_archives(W.normalize_archives(W.write_archives(pages.limit(0), f"{folder}/r2"), f"{folder}/n2")).count() == 0


def test_ids_of_pages_stay(spark, monkeypatch):
    """Ids beyond 2^53 with and without nulls, repeated ids, and more repeated payloads than are broadcast."""
    big = 2**53
    sets = [
        [(big + 1, "a"), (big + 3, "a"), (big + 5, "b"), (None, "a")], [(big + 1, "a"), (big + 3, "a")],
        [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "y"), (0, "y"), (3, None), (4, "")], [(i, f"p{i % 7}") for i in range(3000)],
    ]
    for most in (200_000, 0):
        monkeypatch.setattr(W, "BROADCAST_ROWS", most)
        for rows in sets:
            pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string").repartition(3)
            folder = scratch(spark, "test-warc-ids")
            back = W.read_archives(W.normalize_archives(W.write_archives(pages, f"{folder}/raw"), f"{folder}/normal"))
            least = {}
            for i, h in rows:
                if i is not None:
                    least[h or ""] = min(i, least.get(h or "", i))
            want = Counter((i, W.payload_digest((h or "").encode()), None if i is None or least[h or ""] == i else least[h or ""]) for i, h in rows)
            assert Counter((r["page_id"], r["payload_digest"], r["refers_to"]) for r in back.collect()) == want


def test_damaged_archives():
    record = W.record_bytes(1, "u", b"payload", W.payload_digest(b"payload"), None)
    assert [r for _, r in W.records(iter([record[:50], record[50:] + record]))] == [record, record]
    for bad in (record[:-20], record[:30], b"no record\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(W.records(iter([bad])))
    with pytest.raises(ValueError):
        W.row_of(record.replace(b"payload\r\n", b"paYload\r\n"))
    many = gzip.compress(record) + gzip.compress(record)
    import io

    assert b"".join(W.inflated(io.BytesIO(many))) == record * 2
    assert open_fs("file:///tmp/x")[1] == "/tmp/x"
