"""ZIP packages, language model and pipeline."""

import hashlib
import io
import struct
import zipfile

import pytest
import tiktoken
import base64

import corpus_pipeline
from tabstat.llm import bpe, decontaminate, quality, warc_zip
from tests.conftest import SF001
from tests.llm.test_joins import classes_of, grams, plain_line_dedup


def package(zip64, before=b"", comment=b""):
    parts, lines, at = [], [], 0
    for i in range(5):
        payload = b"x" * (10 * i)
        raw = warc_zip.gzip.compress(warc_zip.record(i, "http://u/ \n", payload, hashlib.sha1(payload).digest(), 0 if i == 3 else None, "1970-01-01T00:00:00Z"))
        lines.append(f"{i} 19700101000000 " + warc_zip.json.dumps({"offset": at, "length": len(raw), "filename": "data.warc.gz"}) + "\n")
        parts.append(raw)
        at += len(raw)
    out = io.BytesIO(warc_zip._package(parts, lines, zip64))
    if comment:
        with zipfile.ZipFile(out, "a") as z:
            z.comment = comment
    return before + out.getvalue()


def widen(raw):
    """The package with a ZIP64 directory: every entry's sizes and place moved
    to the extra field, and the end record's numbers to the ZIP64 one."""
    end = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HLL", raw, end + 10)
    old, new, i = raw[start : start + length], b"", 0
    for _ in range(count):
        packed, full, n, m, c = struct.unpack_from("<LLHHH", old, i + 20)
        place = struct.unpack_from("<L", old, i + 42)[0]
        head = bytearray(old[i : i + 46])
        struct.pack_into("<LL", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", head, 30, 28)
        struct.pack_into("<L", head, 42, 0xFFFFFFFF)
        new += bytes(head) + old[i + 46 : i + 46 + n] + struct.pack("<HHQQQ", 1, 24, full, packed, place)
        i += 46 + n + m + c
    wide = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(new), start)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(new), 1)
    last = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return raw[:start] + new + wide + locator + last


@pytest.mark.parametrize("raw", [package(True), package(False), package(True, comment=b"PK\x05\x06 no end" * 9), widen(package(True)), package(False, before=b"junk" * 50), b"front" + widen(package(False))])
def test_packages(raw):
    got = list(warc_zip.records(io.BytesIO(raw), len(raw)))
    assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in got] == [
        (str(i), "revisit" if i == 3 else "response", 10 * i, "0" if i == 3 else None) for i in range(5)]
    assert got[4]["payload"] == b"x" * 40 and got[3]["payload"] is None and got[0]["target_uri"] == "http://u/%20%0A"


def test_broken_packages():
    with pytest.raises(zipfile.BadZipFile):
        warc_zip.directory(io.BytesIO(b"no zip"), 6)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.INDEX, "x" * 100)
    with pytest.raises(zipfile.BadZipFile):
        list(warc_zip.records(out, len(out.getvalue())))


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality_report(spark.read.parquet(f"{SF001}/documents.parquet"), labels).collect()}
    kept = sorted((d, t) for d, t in docs if verdict[d])
    gone = plain_line_dedup([(i, t) for i, (_, t) in enumerate(kept)])
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) if g else t) for (d, t), g in zip(kept, gone)]
    kept = [(d, t) for d, t in kept if t.strip(" \t\n\x0b\x0c\r")]
    sets = [grams(t) for _, t in kept]
    links = [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    kept = [kept[i] for i in sorted(set(classes_of(len(kept), links)))]
    m = decontaminate.Matcher([(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()])
    clean = []
    for d, t in kept:
        w = decontaminate.words(t.encode())
        hit = sum(b - a for a, b in m.scan(w)[1])
        if not (hit and 20 * hit >= len(w)):
            clean.append((d, t))
    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = [(d, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean]
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF001).collect())
    assert got == want
    assert len(docs) > len(kept) >= len(clean)


def test_oracles(spark):
    import duckdb

    from tabstat.llm.queries import ORACLES, QUERIES
    from tools.check_oracles import compare

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF001)
        res = con.execute(sql)
        assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) is None, name
