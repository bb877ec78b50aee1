"""Token files (1), SentencePiece (7), WARC (2): exact against the libraries and by round trips."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siltstone.llm import sentencepieces, store, tokenfile, warc

random.seed(12)
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", "a ", "  a  b   ", "\n\n a", "x<|endoftext|> y <|endoftext|>", "▁a ▁▁b", "<s> x </s>", "日本語 テキスト", "\x00a\x01 b", "😀 😀😀", "é" * 300, "a" * 5000, "İ ß Å", "it's don't 'll 're a'm", "a b c　d", "x\x85y \x1c z"]
_LETTERS = [*" a\n\tbé日 ​　's19.,\x85\x1c▁", "<|endoftext|>", " the", "  "]
TEXTS = ODD + ["".join(random.choice(_LETTERS) for _ in range(random.randint(0, 30))) for _ in range(1500)]


def test_byte_ids_are_the_library_s():
    library = Tokenizer.from_file(BYTES)
    own = tokenfile.Encoder(BYTES)
    for _ in range(2):  # the second time from the table
        ids, bounds = own.encode(pa.array(TEXTS))
        want = [e.ids for e in library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    own.table._limit = 5_000  # a table that is full all the time
    ids, bounds = own.encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_piece_ids_are_the_library_s():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepieces.Encoder(PIECES)
    assert own.by_chunk
    want = library.encode([t or "" for t in TEXTS], add_bos=True, add_eos=True, num_threads=1)
    for by_chunk in (True, True, False):
        own.by_chunk = by_chunk
        ids, bounds = own.encode(pa.array(TEXTS))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


@pytest.mark.parametrize("top", [100, 60_000, 1 << 32])
def test_addressable_codes(tmp_path, top):
    ids = np.random.default_rng(top % 97).integers(0, top, tokenfile.SEGMENT + 5000).astype(np.uint32)
    ids[::7] %= 256
    uri = f"file://{tmp_path}/x.dac"
    w = tokenfile.Writer(uri)
    for k in range(0, len(ids), 70_001):
        w.write(ids[k : k + 70_001])
    w.close()
    r = tokenfile.Reader(uri)
    assert r.count == len(ids) and (r.tokens(0, len(ids)) == ids).all() and len(r.tokens(5, 0)) == 0
    for i in [0, 1, 511, 512, tokenfile.SEGMENT - 1, tokenfile.SEGMENT, len(ids) - 1, *random.sample(range(len(ids)), 100)]:
        assert r.token(i) == ids[i]
    assert (r.tokens(tokenfile.SEGMENT - 300, 900) == ids[tokenfile.SEGMENT - 300 :][:900]).all()
    with pytest.raises(IndexError):
        r.token(len(ids))
    with pytest.raises(ValueError):
        with store.create(f"file://{tmp_path}/y.dac") as f:
            f.write(b"\0" * 64)
        tokenfile.Reader(f"file://{tmp_path}/y.dac")


def test_token_files(spark):
    rows = [(k * 3 % 1009, t) for k, t in enumerate(TEXTS[:400])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    library, want, n = Tokenizer.from_file(BYTES), [], 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, n, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        n += len(ids)
    assert sorted(map(tuple, tokenfile.digest(d, BYTES).collect())) == want
    index = tokenfile.write_tokens(d, BYTES)
    some = tokenfile.read_tokens(index.filter("id < 50")).collect()
    assert {r["id"]: r["ids"] for r in some} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i < 50}
    assert tokenfile.digest(d.limit(0), BYTES).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in tokenfile.digest(twice, BYTES).orderBy("start").collect()] == [(None, 0), (1, 2), (1, 4), (1, 6)]


def test_pieces_query(spark):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a", "x")], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in sentencepieces.digest(d, PIECES).collect():
        ids = library.encode((ODD[r["doc_id"]] if r["doc_id"] is not None else "a") or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    out = sentencepieces.encode(d, PIECES, decode=True)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in sentencepieces.decode(out.drop("decoded"), PIECES).collect()} == {r["doc_id"]: r["decoded"] for r in out.collect()}
    assert sentencepieces.digest(d.limit(0), PIECES).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(3, "http://a/x", big), (1, "http://a/1", "small"), (2, None, "small"), (7, "http://b\r\n/y", big), (5, "u", None), (6, "u", ""), (None, "u", big), (9, "u", big), (9, "u", big), (8, "u", "x" * 100), (4, "u", "x" * 100), (10, "u", "y" * 300_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    got = sorted((tuple(r) for r in warc.digest(d).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((j for j, _, o in rows if j is not None and (o or "") == (h or "")), default=None)
        again = len(raw) >= 100 and i is not None and i > first
        want.append((i, "revisit" if again else "response", first if again else None, hashlib.sha256(raw).hexdigest(), len(raw)))
    columns = [c for c in warc.digest(d).columns]
    order = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    assert sorted((tuple(r[columns.index(c)] for c in order) for r in got), key=str) == sorted(want, key=str)
    index = warc.write_archives(d, f"file://{tmp_path}/warc")
    some = warc.read_records(index.filter("page_id in (1, 7, 10)")).collect()
    assert {r["page_id"]: r["payload"] and bytes(r["payload"]).decode() for r in some} == {1: "small", 7: None, 10: "y" * 300_000}
    named, referred = set(), set()
    for f in (tmp_path / "warc").iterdir():  # any reader of gzip members reads them
        records = gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\n")[1:]
        assert records[0].startswith(b"WARC-Type: warcinfo\r\n")
        for head in (r.partition(b"\r\n\r\n")[0].decode().split("\r\n") for r in records):
            fields = dict(line.split(": ", 1) for line in head if ": " in line)
            named.add(fields["WARC-Record-ID"])
            referred |= {fields["WARC-Refers-To"]} if fields["WARC-Type"] == "revisit" else set()
    assert referred and referred <= named
    assert warc.digest(d.limit(0)).count() == 0


def test_ids_are_read_in_runs(spark, monkeypatch):
    d = spark.createDataFrame([(i, "a b c d e f g h") for i in range(20)], "doc_id long, text string")
    index = tokenfile.write_tokens(d.coalesce(1), BYTES)
    whole = {r["id"]: r["ids"] for r in tokenfile.read_tokens(index).collect()}
    rows = index.toPandas().sort_values(["file", "at"])
    monkeypatch.setattr(tokenfile, "READ_IDS", 2 * int(rows["n_tokens"].iloc[0]))
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    got = [b.to_pydict() for b in tokenfile._read(iter([batch]), "ids")]
    assert [len(b["id"]) for b in got] == [2] * 10
    assert {i: x for b in got for i, x in zip(b["id"], b["ids"])} == whole
    starts = np.array([0, 5, 5_000, 20_000, 0])
    monkeypatch.setattr(tokenfile, "READ_IDS", 6_000)
    assert list(tokenfile._runs([*"aaaab"], starts, starts + 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_payloads_are_handed_on_by_bytes(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(i, "u", chr(97 + i) * 5000) for i in range(20)], "page_id long, url string, html string")
    index = warc.write_archives(d.coalesce(1), f"file://{tmp_path}/warc").toPandas().sort_values(["archive", "offset"])
    monkeypatch.setattr(warc, "RANGE", 12_000)
    batch = pa.RecordBatch.from_pandas(index[["archive", "offset", "length"]], preserve_index=False)
    got = [b.to_pydict() for b in warc._read(iter([batch]), True)]
    assert [len(b["payload"]) for b in got] == [3] * 6 + [2]
    assert {i: p for b in got for i, p in zip(b["page_id"], b["payload"])} == {i: (chr(97 + i) * 5000).encode() for i in range(20)}


def test_ranges_are_coalesced():
    offsets, lengths = np.array([0, 10, 20, 200_000, 200_010]), np.array([10, 10, 10, 10, 10])
    assert list(warc._ranges(offsets, lengths)) == [(0, 3), (3, 5)]
