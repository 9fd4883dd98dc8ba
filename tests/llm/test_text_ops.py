"""Mixing, GIF media, packing and substring dedup against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import core, gif_media, mixing, packing, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- words -----------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a bb\tccc", "", "bb", " \n ", "É a", "A B"]
    import pyarrow as pa

    buf, bounds = core.utf8(pa.array(texts))
    found = core.Words(buf, bounds)
    assert found.counts.tolist() == [len(words(t)) for t in texts]
    got = [core.text_of(buf, a, b) for a, b in zip(found.start, found.end)]
    assert got == [w for t in texts for w in words(t)]
    h = found.hashes()
    flat = [w.lower() for w in got]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    w = core.windows(np.array([5, 6, 5, 6, 5], dtype=np.uint64), 2)
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


def test_n_words(spark, docs, rows):
    got = {r[0]: r[1] for r in docs.select("doc_id", core.n_words(F.col("text"))).collect()}
    assert got == {r[0]: len(words(r[1])) for r in rows}


# --- mixing ----------------------------------------------------------------------------------------------


def brute_targets(sizes, weights):
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= set(over)
    return out


def test_mix(spark, docs, rows):
    got = mixing.mix(spark, docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    goal = brute_targets(sizes, mixing.default_weights(sizes))
    assert mixing.default_weights(sizes) == {"b": 1, "hot": 2, "ä": 3, None: 1}
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(spark, docs.repartition(5)).collect()), key=str)


def test_mix_rows_keeps_columns_and_copies(spark, docs):
    odd = docs.withColumn("h", F.lit(1)).withColumn("size", F.lit("x")).withColumn("copies", F.lit(2.5))
    plan = table(mixing.mix(spark, odd))
    got = mixing.mix_rows(spark, odd)
    assert got.columns == odd.columns
    counts = {r[0]: r[1] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: r["copies"] for k, r in plan.items() if r["copies"]}


def test_mix_small_tables(spark, docs):
    assert mixing.mix(spark, docs.limit(0)).collect() == []
    one = spark.createDataFrame([(1, None, None), (None, "a b", None), (3, "", "s")], "doc_id long, text string, source string")
    got = sorted(((r["source"] or "", r["target"]) for r in mixing.mix(spark, one).collect()))
    assert got == [("", 2.0), ("", 2.0), ("s", 0.0)]


# --- GIF -------------------------------------------------------------------------------------------------


def lzw_encode(pixels: bytes, size: int) -> bytes:
    """A plain variable-width encoder, for streams of the general form."""
    clear, out, acc, bits = 1 << size, bytearray(), 0, 0

    def put(code, width):
        nonlocal acc, bits
        acc |= code << bits
        bits += width
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    table, width = {bytes([i]): i for i in range(clear)}, size + 1
    put(clear, width)
    now, top = b"", clear + 2
    for b in pixels:
        new = now + bytes([b])
        if new in table:
            now = new
            continue
        put(table[now], width)
        if top < 4096:
            table[new] = top
            top += 1
            if top - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width, top = {bytes([i]): i for i in range(clear)}, size + 1, clear + 2
        now = bytes([b])
    if now:
        put(table[now], width)
    put(clear + 1, width)
    put(0, 7)
    return bytes(out)


def lzw_read(data: bytes, size: int) -> bytes:
    """A plain decoder, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, width, table, last, out = 1 << size, 0, size + 1, {}, None, b""
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, size + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else last + last[:1]
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
        width = min(12, max(size + 1, len(table).bit_length()))
        last, out = entry, out + entry


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_general(size):
    rng = random.Random(size)
    for n in (0, 1, 5, 700, 9000, 60000):
        pixels = bytes(rng.choice(range(1 << size)) if rng.random() < 0.3 else 1 for _ in range(n))
        assert gif_media.lzw_decode(lzw_encode(pixels, size), size, n).tobytes() == pixels
        own = gif_media.lzw_encode(pixels, size)
        assert lzw_read(own, size) == pixels and gif_media.lzw_decode(own, size, n).tobytes() == pixels
    flat = gif_media.lzw_encode(b"\x01" * 60000, size)
    assert lzw_read(flat, size) == b"\x01" * 60000 and len(flat) < 700
    with pytest.raises(ValueError):
        gif_media.lzw_decode(gif_media.lzw_encode(b"\x01\x02\x03", size), size, 4)


def gif(frames, width=4, height=3, palette=None):
    """frames: (x, y, w, h, pixels, disposal, transparent, delay, interlaced)."""
    import struct

    palette = palette or [(10 * i, i, 255 - i) for i in range(4)]
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0b10000001, 0, 0) + bytes(v for c in palette for v in c)
    for x, y, w, h, pixels, disposal, transparent, delay, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\x00"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlaced else 0) + b"\x02"
        data = lzw_encode(bytes(pixels), 2)
        for i in range(0, len(data), 255):
            out += bytes([len(data[i : i + 255])]) + data[i : i + 255]
        out += b"\x00"
    return out + b"\x21\xfe\x02hi\x00;"


def test_gif_disposal_transparency_interlace():
    palette = np.array([(10 * i, i, 255 - i) for i in range(4)], dtype=np.uint8)
    data = gif([(0, 0, 4, 3, [1] * 12, 1, None, 5, False), (1, 1, 2, 1, [2, 0], 3, 0, 7, False), (0, 0, 1, 1, [3], 2, None, 0, False), (0, 0, 4, 3, [2, 0, 0, 0] * 2 + [1, 0, 0, 0], 0, 0, 9, True)])
    a, b, c, d = [*gif_media.decode(data)]
    assert [f.delay for f in (a, b, c, d)] == [5, 7, 0, 9]
    assert (a.rgb == palette[1]).all()
    assert (b.rgb[1, 1] == palette[2]).all() and (b.rgb[1, 2] == palette[1]).all()
    assert (c.rgb[1, 1] == palette[1]).all() and (c.rgb[0, 0] == palette[3]).all()  # frame b was undone
    assert (d.rgb[0, 0] == palette[2]).all() and (d.rgb[0, 1] == palette[1]).all()
    assert (d.rgb[1, 0] == palette[1]).all() and (d.rgb[2, 0] == palette[2]).all()  # stored rows 0, 2, 1
    with pytest.raises(ValueError):
        gif_media.lzw_decode(b"\x04", 2, 5)


def test_media_round_trip(spark, docs, rows):
    got = table(gif_media.media(docs, with_bytes=True))
    for doc_id, text, *_ in rows:
        raw, r = (text or "").encode(), got[doc_id]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        frames = [*gif_media.decode(bytes(r["media"]))]
        assert b"".join(f.rgb[:, :, 1].tobytes() for f in frames) == payload and (r["n_frames"], r["duration_ms"]) == (len(frames), 40 * len(frames))
        counts = [sum(b >> 4 == k for b in payload) for k in range(16)]
        assert r["feature"] == ",".join(map(str, counts * 3))
    assert gif_media.media(docs.limit(0)).collect() == []


def test_media_depends_on_codes_palette_and_transparency():
    payload = np.frombuffer((b"the same words again, and again. " * 60)[:1728], dtype=np.uint8)
    data = gif_media.encode(payload)
    assert len(data) < 781 + 1728  # runs are found
    _, _, _, _, images = gif_media.parse(data)
    assert [m["transparent"] is not None for m in images] == [False, True, True]
    read = lambda d: np.concatenate([f.rgb[:, :, 0].ravel() for f in gif_media.decode(d)])
    assert (read(data) == payload).all()
    ground = data[:13] + bytes(767) + data[780:]
    assert not read(ground).all()  # a black palette
    first = 781 + 19
    broken = bytearray(data)
    broken[first + 40] ^= 0x10  # a bit of a code
    try:
        assert (read(bytes(broken)) != payload).any()
    except ValueError:
        pass
    opaque = data.replace(b"\x21\xf9\x04\x05", b"\x21\xf9\x04\x04")
    assert (read(opaque) != payload).any()
    full = np.tile(np.arange(256, dtype=np.uint8), 9)  # frames that leave no index unused
    assert (read(gif_media.encode(full[: 4 * 576])) == full[: 4 * 576]).all()


def test_frames_side_by_side_equal_single_ones(monkeypatch):
    rng = random.Random(3)
    payloads = [np.frombuffer(bytes(rng.choice(range(rng.choice([2, 30, 256]))) for _ in range(576 * rng.randint(1, 6))), dtype=np.uint8) for _ in range(40)]
    stored = gif_media.encode_all(payloads)
    for payload, data in zip(payloads, stored):
        images = gif_media.parse(data)[4]
        index = [*gif_media.indexes(images)]
        assert [m["codes"] for m in images] == [gif_media.lzw_encode(x.tobytes(), 8) for x in index] == [m["codes"] for m in gif_media.parse(gif_media.encode(payload))[4]]
        assert [x.tobytes() for x in index] == [lzw_read(m["codes"], 8) for m in images]
        assert b"".join(f.rgb[:, :, 2].tobytes() for f in gif_media.decode(data)) == payload.tobytes()
    large = np.tile(payloads[0], 90 * 90)[: 3 * 90 * 90]
    assert np.array_equal(np.concatenate([f.rgb[:, :, 0].ravel() for f in gif_media.decode(gif_media.encode(large, side=90))]), large)
    wide = [lzw_encode(bytes(rng.choice(b"abc") for _ in range(n)), 8) for n in (575, 576, 577)]  # too short, right, too long
    assert [x is not None for x in gif_media._decode_abreast(wide, 576)] == [False, True, False]


def test_frames(spark, docs, rows):
    stored = gif_media.media(docs, with_bytes=True)
    got = gif_media.frames(stored.select("doc_id", "media")).orderBy("doc_id", "frame").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in rows:
        raw, found = (text or "").encode(), by[doc_id]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert [(r["frame"], r["at_ms"], r["delay_ms"], r["width"], r["height"]) for r in found] == [(k, 40 * k, 40, 24, 24) for k in range(len(payload) // 576)]
        assert b"".join(bytes(r["rgb"])[::3] for r in found) == payload
        assert all(r["red"] == r["green"] == r["blue"] == [sum(b >> 4 == k for b in payload[576 * i : 576 * (i + 1)]) for k in range(16)] for i, r in enumerate(found))


# --- packing ---------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizers_library(rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [r[1] or "" for r in rows] + ["it's  <|endoftext|> don't\n\n x", "日本語 テスト 123456", "a" * 500, "\x00\x01\x7f\xad"]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [packing.encoder(path)(x) for x in texts]


@pytest.mark.parametrize("n", [31, 32, 33, 100, 1_000, 19_000, 400_000])
def test_encoder_is_linear_in_white_space(n):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.encoder(path, added=True)
    for space in (" ", "\n", " \t", "\u3000", "\x1c", "\x85 "):
        run = (space * n)[:n]
        for text in (f"a{run}b", run, f"{run}'s", f"x{run}\u00a0.{run}", f"a{run}<|endoftext|>{run}b", f"<|endoftext|>{run}", f"{run}\x1d{run}é"):
            assert encode(text) == t.encode(text, add_special_tokens=False).ids
    text = ("x" + " " * n) * max(1, 1_000_000 // n)
    start = time.perf_counter()
    encode(text)
    assert time.perf_counter() - start < 2 * len(text) / 1e6


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a\n" + "\u00a0\t " * 1_800_000, "x" * 5_000_000, "ab" + " " * 30_000 + "<|endoftext|> y", "é!" * 400_000])
def test_encoder_takes_very_long_runs(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.encoder(P.path("byte_bpe_50k.json"), added=True)(text) == t.encode(text, add_special_tokens=False).ids


def test_pack_takes_added_tokens_as_the_tokenizers_library_does(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in rows] + ["a<|endoftext|>b", "<|endoftext|>", " x  <|endoftext|>\n<|endoftext|><|endoftext|> y", "<|endoftext|", "<|<|endoftext|>|>", "it's <|EndOfText|>"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[len(rows)] == [64, 50256, 65]
    assert want == [packing.encoder(path, added=True)(x) for x in texts]
    got = packing.pack(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, width=1 << 14).collect()
    ends = [np.array([*ids, 2], dtype="<u4") for ids in want]
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in enumerate(ends)}


@pytest.mark.parametrize("width", [7, 64])
def test_plan_is_best_fit_decreasing(width):
    rng = random.Random(width)
    for _ in range(60):
        lengths = [rng.randint(1, width) for _ in range(rng.randint(1, 200))]
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [(r, i) for i, r in enumerate(free) if r >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(width - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, bins = packing.plan(counts, width), {}
        for n, count in counts.items():
            for k in range(count):
                run = [r for r in runs if r[0] == n and r[1] <= k][-1]
                b, j = divmod(k - run[1], run[3])
                bins.setdefault(run[2] + b, []).append((run[4] + j * n, n))
        assert len(bins) == len(free)
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= width


def test_pack(spark, docs, rows):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    got = packing.pack(spark, docs, path, width=128).collect()
    encode, by_doc, by_bin = packing.encoder(path), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text, *_ in rows:
        ids, parts = np.array([*encode(text or ""), 2], dtype="<u4"), sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        assert all(p["length"] == 128 for p in parts[1:])
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for items in by_bin.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert packing.pack(spark, docs.limit(0), path).collect() == []


# --- substring dedup -------------------------------------------------------------------------------------


def brute_removal(rows, length):
    seen, kept = {}, {}
    flat = sorted((r[0], words(r[1])) for r in rows)
    for doc_id, w in flat:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[s : s + length]), (doc_id, s)) != (doc_id, s):
                gone[s : s + length] = [True] * length
        kept[doc_id] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return kept


@pytest.mark.parametrize(("length", "base"), [(20, 10), (20, 5), (8, 8), (8, 1)])
def test_substring(spark, docs, rows, length, base):
    got = table(substring.digests(spark, docs, length=length, base=base, buckets=5))
    want = brute_removal(rows, length)
    assert len(got) == len(rows) and any(w[1] for w in want.values())
    for doc_id, (n, removed, kept) in want.items():
        assert (got[doc_id]["n_words"], got[doc_id]["n_removed"]) == (n, removed)
        assert got[doc_id]["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substring_rows(spark, docs, rows):
    odd = docs.withColumn("home", F.lit("mine")).withColumn("data", F.array(F.lit(1)))
    got, want = table(substring.rows(spark, odd)), brute_removal(rows, 20)
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert r["home"] == "mine" and r["data"] == [1]
        assert r["text"] == (text if not want[doc_id][1] else " ".join(want[doc_id][2]))
    empty = substring.digests(spark, docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_substring_repeated_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, None), (7, text + " tail")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.digests(spark, df).collect())
    assert got == [("5", 30), ("5", 30), ("7", 30), ("9", 0), ("None", 0)]


def test_substring_tells_different_texts_of_one_id_apart(spark):
    a, b = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(45))
    df = spark.createDataFrame([(5, a), (5, b), (None, b), (None, a + " x"), (None, None), (6, f"{b} {a}"), (4, "short")], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.digests(spark, df).collect()}
    assert got == {(5, 30): 30, (5, 45): 45, (None, 45): 0, (None, 31): 0, (None, 0): 0, (6, 75): 75, (4, 1): 0}
    one = spark.createDataFrame([(7, f"{a} {a} {b}"), (7, b), (8, a)], "doc_id long, text string")
    kept = sorted(r["text"] for r in substring.rows(spark, one).collect())
    # Of the two texts of id 7 one keeps the common passage, and the long one the other.
    assert sum(len(t.split()) for t in kept) == 75 and kept[0] == ""


def test_scratch_tables_belong_to_one_call(spark):
    import os

    mine, other = core.Scratch(spark), core.Scratch(spark)
    a, b = mine.keep(spark.range(5), "a"), other.keep(spark.range(7), "b")
    done = mine.finish(a.where("id > 1"), "done")
    assert (done.count(), b.count(), len(other.paths), mine.paths) == (3, 7, 1, [])
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a.inputFiles()[0]).count()
    assert all(os.path.exists(f.removeprefix("file:")) for f in done.inputFiles())
