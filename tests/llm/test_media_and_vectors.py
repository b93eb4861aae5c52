"""Archives, audio and nearest neighbours."""

import base64
import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import audio, neighbours, warc
from tessera.llm.components import components


def record(i, payload, compress=True):
    return warc.write_record([("WARC-Type", "response"), ("X-Page-Id", str(i))], payload, compress)


def test_salvage_recovers_later_records_and_logs_gaps():
    rng = random.Random(1)
    for compress in (True, False):
        parts = [record(i, bytes(rng.randrange(256) for _ in range(300)), compress) for i in range(12)]
        data = b"".join(parts)
        assert [x.headers["X-Page-Id"] for x in warc.read_archive(data)] == [str(i) for i in range(12)]
        broken = bytearray(data)
        at = len(b"".join(parts[:4])) + len(parts[4]) // 2
        broken[at] ^= 0x5A
        broken = bytes(broken[: len(data) - 20])
        got = list(warc.read_archive(b"junk" + broken))
        records = [x for x in got if isinstance(x, warc.Record)]
        gaps = [x for x in got if isinstance(x, warc.Gap)]
        assert [x.headers["X-Page-Id"] for x in records] == [str(i) for i in range(11) if i != 4]
        assert len(gaps) == 3 and gaps[0].start == 0 and gaps[0].end == 4 and gaps[-1].end == len(broken) + 4
        bad = 4 + len(b"".join(parts[:4]))
        assert (gaps[1].start, gaps[1].end) == (bad, bad + len(parts[4]))
    assert list(warc.read_archive(b"")) == []
    false = record(1, b"x\x1f\x8b\x08y WARC/1.0\r\n no record")
    assert len(list(warc.read_archive(false + false))) == 2


def test_members_of_several_records():
    rng = random.Random(5)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(3000)), False) for i in range(12)]
    member = gzip.compress(b"".join(parts), mtime=0)
    assert [x.headers["X-Page-Id"] for x in warc.read_archive(member)] == [str(i) for i in range(12)]
    cut = list(warc.read_archive(member[: len(member) // 2] + record(99, b"y")))
    ids = [x.headers["X-Page-Id"] for x in cut if isinstance(x, warc.Record)]
    assert ids[:4] == ["0", "1", "2", "3"] and ids[-1] == "99" and sum(isinstance(x, warc.Gap) for x in cut) == 1


def test_ordinary_records_are_read():
    """Digests of other kinds, header names in any case, folded and repeated headers."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha1, md5 = hashlib.sha1(body).digest(), hashlib.md5(body).digest()

    def raw(*lines, version="1.0"):
        return f"WARC/{version}\r\n".encode() + "".join(x + "\r\n" for x in (*lines, f"content-length: {len(body)}")).encode() + b"\r\n" + body + b"\r\n\r\n"

    digests = [f"sha1:{base64.b32encode(sha1).decode()}", f"SHA-1:{sha1.hex().upper()}", f"md5:{md5.hex()}", f"sha256:{base64.b64encode(hashlib.sha256(body).digest()).decode()}", "blake9:abc", ""]
    for digest in digests:
        got = list(warc.read_archive(raw("warc-type: response", f"WARC-BLOCK-DIGEST: {digest}")))
        assert len(got) == 1 and got[0].payload == body and got[0].headers["WARC-Type"] == "response", digest
    bad = list(warc.read_archive(raw("WARC-Type: x", f"WARC-Block-Digest: sha1:{base64.b32encode(md5).decode()}")))
    assert [type(x) for x in bad] == [warc.Gap] and bad[0].reason == "digest differs"
    got = list(warc.read_archive(raw("WARC-Type: metadata", "X-Note: one", "  two", "WARC-Concurrent-To: <a>", "warc-concurrent-to: <b>", version="0.18")))
    assert got[0].headers["X-Note"] == "one two" and got[0].headers["WARC-Concurrent-To"] == "<a>, <b>"
    assert isinstance(list(warc.read_archive(b"WARC/1.0\r\n folded: first\r\n\r\n"))[0], warc.Gap)


def test_search_after_damage_is_linear():
    """Many false marks of one kind, far from the next of the other, and headers that never end."""
    began = time.time()
    noise = (b"WARC/1.0\r\nx\r\n" + bytes(90)) * 40_000
    got = list(warc.read_archive(noise + record(1, b"payload") + (b"WARC/1.0\r\na: b\r\n" * 40_000)))
    assert [type(x).__name__ for x in got] == ["Gap", "Record", "Gap"] and got[0].end == len(noise)
    assert time.time() - began < 20


def test_warc_report_of_text_ids(spark):
    long = "x" * 200
    rows = [("", "u", long), ("a\r\nb%20 +é", "u", long), (None, "u", long), (" padded ", "u", "s"), ("", "u", long)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    got = sorted(map(str, (tuple(r)[0::3] + (r["refers_to"],) for r in warc.warc_report(pages).collect())))
    want = [("", "response", None), ("", "response", None), ("a\r\nb%20 +é", "revisit", ""), (None, "revisit", ""), (" padded ", "response", None)]
    assert got == sorted(map(str, want))
    archives = warc.write_archives(pages).select(F.lit("a").alias("archive"), F.expr("concat(content, X'00')").alias("content"))
    gaps = warc.gap_log(warc.read_archives(archives)).collect()
    assert len(gaps) >= 1 and all(g["end"] == g["start"] + 1 and g["reason"] == "no version line" for g in gaps)


def test_warc_report(spark):
    long = "é" * 80
    rows = [(3, "u", long), (1, "v\nw", long), (2, None, long), (5, "x", "short"), (6, "x", "short"), (7, "y", None), (8, "y", ""), (None, "z", long), (9, "z", long + "!")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in warc.warc_report(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {3, 2, None} and {got[i]["refers_to"] for i in (3, 2, None)} == {1}
    assert warc.warc_report(pages.limit(0)).count() == 0
    archives = warc.write_archives(pages, archive_bytes=200)
    cut = archives.select(F.lit("a").alias("archive"), F.expr("substring(content, 1, octet_length(content) - 9)").alias("content"))
    read = warc.read_archives(cut).collect()
    assert any(r["headers"] is None and r["gap_end"] for r in read)


def test_warc_of_very_long_pages(spark):
    long = "<p>é</p>" * 500_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (2, "u", long), (3, None, "")], "page_id bigint, url string, html string")
    got = sorted(tuple(r)[::3] for r in warc.warc_report(pages).collect())
    assert got == [(1, "response"), (2, "revisit"), (2, "revisit"), (3, "response")]


def test_wav_and_payload():
    for text in ("", None, "a", "é" * 288, "x" * 577):
        raw = audio.padded(text)
        assert len(raw) % 576 == 0 and raw and raw.startswith((text or "").encode()) and not raw[len((text or "").encode()) :].strip(b"\xff")
        assert audio.wav_samples(audio.wav_bytes(raw)) == (raw, audio.RATE)


def test_resampling_is_polyphase_of_the_dense_filter():
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    up, down, taps = 2, 3, 16
    kernel = audio._phases(up, down, taps).T.reshape(-1)
    dense = np.zeros(len(x) * up + 4 * up * taps)
    dense[: len(x) * up : up] = x
    full = np.convolve(dense, kernel)
    want = full[up * (taps // 2) :][::down][: -(-len(x) * up // down)]
    assert np.allclose(audio.resample(x, up, down, taps), want, atol=1e-4)


def test_long_files_have_the_features_of_one_piece(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    whole = audio.features(raw)
    monkeypatch.setattr(audio, "_AT_ONCE", 1024)
    parts = audio.features(raw)
    assert whole.mel.shape == parts.mel.shape and np.allclose(whole.mel, parts.mel, atol=1e-3)


def test_log_mel_equals_plain_sums():
    """Frames, window, Fourier sums and triangles written out one by one."""
    x = np.random.default_rng(3).normal(size=700).astype(np.float32)
    rate, size = 10_000, audio.FRAME
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    got = audio.log_mel(x, rate)
    starts = range(0, len(x) - size + 1, audio.HOP)
    assert got.shape == (len(starts), audio.MELS)
    t = np.arange(size)
    for row, start in zip(got, starts):
        frame = x[start : start + size].astype(float) * (0.5 - 0.5 * np.cos(2 * np.pi * t / (size - 1)))
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * t / size))) ** 2 for k in range(size // 2 + 1)]
        for band in range(audio.MELS):
            low, peak, high = edges[band : band + 3]
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / size
                total += p * ((f - low) / (peak - low) if low < f <= peak else (high - f) / (high - peak) if peak < f < high else 0)
            assert abs(row[band] - np.log(total + audio.FLOOR)) < 2e-2


def test_segments_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 300):
        for _ in range(20):
            mel = np.repeat(rng.normal(size=(n, 1)).cumsum(axis=0), audio.MELS, axis=1).astype(np.float32)
            energy = mel.mean(axis=1)
            low = float(energy.mean())
            high, loud, want, began = low + 0.5 * float(energy.std()), False, [], 0
            for i, e in enumerate(energy):
                if not loud and high - low >= 1e-6 and e >= high:
                    loud, began = True, i
                elif loud and e < low:
                    loud = False
                    want.append((began, i))
            if loud:
                want.append((began, n))
            assert audio.energy_segments(mel, 1.0) == [(float(a), float(b)) for a, b in want]


def test_tensors_go_through_the_store():
    raw = np.random.default_rng(5).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    f = audio.features(raw)
    stored = audio.load_tensors(audio.store_tensors(f))
    assert stored.schema.field("mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS] and sum(stored.column("frames").to_pylist()) == len(f.mel)
    mel = stored.column("mel").to_numpy_ndarray()
    held = np.concatenate([m[:n] for m, n in zip(mel, stored.column("frames").to_pylist())])
    assert np.abs(held - f.mel).max() < 0.02
    starts, ends = stored.column("start").to_pylist(), stored.column("end").to_pylist()
    assert starts[0] == 0 and starts[1:] == ends[:-1] and abs(ends[-1] - len(f.mel) * f.seconds_per_frame) < 1e-9
    inside = {(x["start"], x["end"]) for row in stored.column("segments").to_pylist() for x in row}
    assert inside == set(f.segments)


def test_loud_stretch_is_found():
    t = np.arange(32_000)
    loud = np.where((t > 8000) & (t < 20_000), 100 * np.sin(t * 0.3), 2 * np.sin(t * 0.3)) + 128
    f = audio.features(loud.astype(np.uint8).tobytes())
    assert len(f.segments) == 1
    start, end = f.segments[0]
    assert abs(start - 8000 / 16_000) < 0.05 and abs(end - 20_000 / 16_000) < 0.05


def test_media_report_and_tensors(spark):
    rows = [(1, "hello world " * 200), (2, None), (3, ""), (4, "hello world " * 200), (None, "ü")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = audio.media_report(docs).collect()
    for r in got:
        raw = audio.padded(dict(rows)[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-32:]) and r["payload_bytes"] == len(raw)
        assert r["media_sha256"] == hashlib.sha256(audio.wav_bytes(raw)).hexdigest()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["feature"] == by[4]["feature"] != by[2]["feature"] == by[3]["feature"]
    tensors = audio.audio_tensors(audio.text_media(docs)).orderBy("id", "tensor_no").toArrow()
    array = audio.as_tensor_array(tensors["mel"])
    assert array.type == pa.fixed_shape_tensor(pa.float32(), (audio.TENSOR_FRAMES, audio.MELS)) and len(array) == tensors.num_rows
    assert all(a < b for a, b in zip(tensors["start"].to_pylist(), tensors["end"].to_pylist()))
    assert audio.media_report(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(7, "word " * 400_000, 1, "m"), (7, "word " * 400_000, 2, "n")], "doc_id bigint, text string, media int, id string")
    twice = audio.media_report(long).collect()
    assert len(twice) == 2 and twice[0]["feature"] == twice[1]["feature"] and twice[0]["n_bytes"] == 2_000_000


def brute_nearest(rows, asked, top):
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in good:
        if asked(q):
            s = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in good if i != q)
            out[q] = [i for _, i in s[:top]]
    return out


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 4)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(9)] + [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] * 8), (2030, [1.0] * 7 + [None]), (None, rows[0][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(rows, lambda q: q % 10 == 0, 5)
    assert got.keys() == want.keys() and got[0] == [1000, 1001, 1002, 1003, 1004] and got[1000] == [0, 1001, 1002, 1003, 1004]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_search_goes_on_until_the_beam_is_expanded(spark):
    angles = np.pi * np.arange(12) / 12
    codes = [(i, bytearray(np.rint(127 * np.array([np.cos(a), np.sin(a)])).astype(np.int8).tobytes())) for i, a in enumerate(angles)]
    nodes = spark.createDataFrame(codes, "node bigint, code binary")
    chain = spark.createDataFrame([(i, i + 1, 0.9) for i in range(11)], "node bigint, other bigint, sim float")
    found = neighbours.search_graph(chain, nodes, spark.createDataFrame([(0,)], "query bigint"))
    assert {r["other"] for r in found.collect()} == set(range(1, 12))


def test_large_cells_are_split_by_nearness(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    x = np.repeat(centres, 60, axis=0) + 0.01 * rng.normal(size=(480, 16))
    codes = [(i, bytearray(np.rint(v / np.abs(v).max() * 127).astype(np.int8).tobytes()), 0) for i, v in enumerate(x)]
    rows = neighbours._split_cells(spark.createDataFrame(codes, "node bigint, code binary, cell bigint"), 7).collect()
    cells = {}
    for r in rows:
        cells.setdefault(r["cell"], []).append(r["node"])
    assert sorted(r["node"] for r in rows) == list(range(480)) and max(map(len, cells.values())) <= 64
    alike = spark.createDataFrame([(i, codes[0][1], 0) for i in range(100)], "node bigint, code binary, cell bigint")
    assert neighbours._split_cells(alike, 7).count() == 100


def test_nearest_with_clashing_columns(spark):
    """Other columns, named like those that the operator makes, neither disturb it nor come out."""
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i, 0.5, 7, "x", [i], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node bigint, sim double, unit int, query string, ids array<int>, v int")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    plain = neighbours.nearest(df.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in plain.collect()) and found.count() == 15


def test_beam_grows_with_the_rows():
    assert [neighbours.beam_width(n) for n in (0, 1, 1000, 1 << 16, (1 << 16) + 1, 10**5, 2 * 10**5, 10**9)] == [192, 192, 192, 192, 224, 224, 256, 640]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.707107), (0, 2, 1, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
