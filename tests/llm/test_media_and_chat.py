"""Motion-JPEG round trips and chat logs."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import avi, chat


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 9, b"\xff" * 575, b"\xff" * 576, b"\0" * 577])
def test_payload_round_trip(data):
    payload = avi.pad_payload(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    (media,) = avi.encode_media([payload])
    back, hist, counts, step = avi.decode_media([media])
    assert back == [payload]
    assert counts.tolist() == [len(payload) // 576]
    assert hist.sum(1) == pytest.approx(1)
    frames, seconds = avi.read_avi(media)
    assert seconds == pytest.approx(1 / avi.FPS)
    slow = [np.sort(avi.decode_frame(f).ravel()) for f in frames]
    quick = np.sort(avi.own_pixels(np.frombuffer(payload, np.uint8)), axis=1)
    assert all((a == b).all() for a, b in zip(slow, quick, strict=True))


def test_index_is_optional():
    (media,) = avi.encode_media([avi.pad_payload(b"x" * 2000)])
    at = media.index(b"idx1")
    cut = media[:at]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert avi.read_avi(cut)[0] == avi.read_avi(media)[0]
    with pytest.raises(ValueError, match="AVI"):
        avi.read_avi(b"RIFFxxxxWAVE")


def flat_jpeg(level):
    """A grey frame of one level by another coder: two-bit codes, no restarts."""
    dc = (level - 128) * 8
    size = abs(dc).bit_length()
    bits = "00" + (format(dc if dc > 0 else dc + (1 << size) - 1, f"0{size}b") if size else "")
    if size == 0:
        bits = "01"
    bits += "00" + ("01" + "00") * 8
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    table = lambda kind, values: bytes([kind, 0, len(values)] + [0] * 14) + bytes(values)
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHB", 8, 24, 24, 1) + b"\1\x11\0") + seg(0xC4, table(0, [size or 1, 0])) + seg(0xC4, table(0x10, [0])) + seg(0xDA, b"\1\1\0\0\x3f\0")
    return head + scan + avi.EOI


def test_shots_of_other_coders(spark):
    levels = [60] * 8 + [200] * 8 + [61] * 6
    media = avi.write_avi([flat_jpeg(v) for v in levels])
    assert {int(avi.decode_frame(f).mean()) for f in avi.read_avi(media)[0]} == {60, 61, 200}
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")
    got = [(r.clip, r.first_frame, r.frames, round(r.start_s, 2), round(r.end_s, 2)) for r in avi.clips(df).orderBy("clip").collect()]
    assert got == [(0, 0, 8, 0.0, 0.32), (1, 8, 8, 0.32, 0.64), (2, 16, 6, 0.64, 0.88)]


def test_digests(spark):
    rows = [(1, "abc", 3), (2, None, 3), (3, "", 3), (4, "é" * 60_000, 3), (5, "abc", 3), (5, "abc", 3), (None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = avi.media_digests(avi.store_text(docs)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        data = (t or "").encode()
        payload = avi.pad_payload(data)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by[1].media_sha256 == by[5].media_sha256 and by[1].feature == by[5].feature
    assert avi.media_digests(avi.store_text(docs.limit(0))).count() == 0


HARD = ["", "\\", "\\\\", "### ", "</turn>", "\\### Assistant: </turn> ok", "a\n### user: b</turn>\n", "\\</turn>", "###", "</turn", "x: y", "\\n"]


def test_escaping_round_trip():
    for role in [*HARD, "user"]:
        for text in HARD:
            ((r, t, a, b),) = chat.parse(chat.render_turn(role, text))
            assert (r, t) == (role, text)
            assert chat.unescape(chat.render_turn(role, text)[a:b]) == text
    both = "".join(chat.render_turn("user", t) for t in HARD)
    assert [t for _, t, _, _ in chat.parse(both)] == HARD
    with pytest.raises(ValueError, match="turn"):
        chat.parse("no turn")


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, message int, seq long, kind string, role string, text string")


def test_fold(spark):
    events = log(
        spark,
        [
            (1, 0, 0, "begin", "user", "hi"),
            (1, 1, 1, "begin", "assistant", ""),
            (1, 1, 2, "delta", None, "he"),
            (1, 1, 3, "delta", None, "llo"),
            (1, 0, 4, "edit", None, "hey"),
            (1, 2, 5, "begin", "user", "dropped"),
            (1, 1, 6, "regenerate", None, ""),
            (1, 1, 7, "delta", None, "good day"),
            (1, 3, 8, "begin", "user", "bye"),
            (2, 0, None, "begin", None, None),
        ],
    )
    got = chat.format_chats(chat.fold_events(events)).orderBy("conv_id", "nth").collect()
    assert [(r.conv_id, r.nth, r.role, r.rendered) for r in got] == [
        (1, 0, "user", "### user: hey</turn>\n"),
        (1, 1, "assistant", "### assistant: good day</turn>\n"),
        (1, 2, "user", "### user: bye</turn>\n"),
        (2, 0, "", "### : </turn>\n"),
    ]
    whole = "".join(r.rendered for r in got if r.conv_id == 1)
    spans = [whole[r.loss_start : r.loss_end] for r in got if r.conv_id == 1 and r.loss_start is not None]
    assert spans == ["good day"]


def test_fold_of_many_deltas(spark):
    said = [(1, 0, 0, "begin", "Assistant", "x")] + [(1, 0, i, "delta", None, f"{i} ") for i in range(1, 20_000)]
    said += [(2, 0, 0, "delta", "assistant", "a"), (2, 0, 1, "delta", None, "b"), (2, 0, 2, "edit", None, "c"), (2, 0, 3, "delta", None, "d")]
    got = {r.conv_id: r for r in chat.format_chats(chat.fold_events(log(spark, said))).collect()}
    assert got[1].rendered == chat.render_turn("Assistant", "x" + "".join(f"{i} " for i in range(1, 20_000)))
    assert got[1].loss_start is None  # another role
    assert got[2].rendered == chat.render_turn("assistant", "cd")


def test_digests_equal_brute_force(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HARD[(c + t) % len(HARD)] if (c + t) % 5 else None) for c in range(6) for t in range(7)]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (9, None, None, "x"), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.format_chats(chat.fold_events(chat.as_events(turns)), with_text=False).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        r = got[c]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render_turn(a, b)) for a, b in said)
    assert chat.format_chats(chat.fold_events(chat.as_events(turns.limit(0))), with_text=False).count() == 0
