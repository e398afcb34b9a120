"""The reader of MPEG audio on streams put together here from the format, not by the operator's own writer."""

import random
from fractions import Fraction

import pytest

from tidemark.llm import mpeg_audio as M


def crc(data):
    """CRC-16 bit by bit over a string of bits."""
    register = [1] * 16
    for bit in "".join(f"{b:08b}" for b in data):
        out = register.pop(0) ^ int(bit)
        register.append(0)
        if out:
            register = [r ^ int(p) for r, p in zip(register, f"{0x8005:016b}")]
    return int("".join(map(str, register)), 2)


#: (version bits, layer bits, bitrate index, rate index, mode): bytes a frame without padding, samples, hertz, bytes a checksum covers
KINDS = {
    "MPEG 1 layer III stereo, 128 kbit/s at 44100": ((3, 1, 9, 0, 0), 417, 1152, 44100, 32),
    "MPEG 1 layer III mono, 64 kbit/s at 32000": ((3, 1, 5, 2, 3), 288, 1152, 32000, 17),
    "MPEG 2 layer III mono, 32 kbit/s at 22050": ((2, 1, 4, 0, 3), 104, 576, 22050, 9),
    "MPEG 2.5 layer III stereo, 16 kbit/s at 8000": ((0, 1, 2, 2, 0), 144, 576, 8000, 17),
    "MPEG 1 layer II stereo, 192 kbit/s at 48000": ((3, 2, 10, 1, 0), 576, 1152, 48000, 0),
    "MPEG 1 layer I stereo, 128 kbit/s at 44100": ((3, 3, 4, 0, 0), 136, 384, 44100, 32),
    "MPEG 1 layer I joint at bound 8, 128 kbit/s at 44100": ((3, 3, 4, 0, 1), 136, 384, 44100, 20),
}


def frame(rng, kind, padding=0, checked=False, size=None):
    (version, layer, kbps, hertz, mode), plain, _, _, covered = KINDS[kind]
    slot = 4 if layer == 3 else 1
    head = bytes((0xFF, 0xE0 | version << 3 | layer << 1 | (not checked), kbps << 4 | hertz << 2 | padding << 1, mode << 6 | (0x10 if mode == 1 else 0)))
    body = bytes(rng.randrange(255) for _ in range((size or plain) + padding * slot - 4 - 2 * checked))  # no 0xFF, so no false header
    return head + (crc(head[2:] + body[:covered]).to_bytes(2, "big") if checked else b"") + body


@pytest.mark.parametrize("kind", KINDS)
def test_frames_offsets_and_durations(kind):
    rng = random.Random(kind)
    _, plain, samples, hertz, covered = KINDS[kind]
    checked = covered > 0
    frames = [frame(rng, kind, rng.randint(0, 1), checked) for _ in range(30)]
    s = M.parse(b"junk" + b"".join(frames[:10]) + b"\xff\xfa noise" + b"".join(frames[10:]))
    at, want = 4, []
    for k, f in enumerate(frames):
        at += 8 if k == 10 else 0
        want.append(at)
        at += len(f)
    assert s.offsets == want and s.sizes == [len(f) for f in frames] and s.skipped == 12
    assert s.seconds == Fraction(30 * samples, hertz) and (s.checked, s.failed) == (30 * checked, 0)
    if checked:
        broken = bytearray(b"".join(frames))
        broken[7] ^= 16
        assert M.parse(bytes(broken)).failed == 1


def test_free_format():
    rng = random.Random(5)
    kind = "MPEG 1 layer III stereo, 128 kbit/s at 44100"
    frames = []
    for k in range(12):
        f = bytearray(frame(rng, kind, k % 2, size=777))
        f[2] &= 0x0F  # bitrate index 0
        frames.append(bytes(f))
    s = M.parse(b"".join(frames) + b"tail")
    assert s.sizes == [len(f) for f in frames] and s.seconds == Fraction(12 * 1152, 44100) and s.skipped == 4


def syncsafe(n):
    return bytes((n >> k) & 127 for k in (21, 14, 7, 0))


def test_tags_of_all_versions():
    rng = random.Random(6)
    audio = b"".join(frame(rng, "MPEG 2 layer III mono, 32 kbit/s at 22050") for _ in range(3))

    def tagged(version, flags, body):
        s = M.parse(b"ID3" + bytes((version, 0, flags)) + syncsafe(len(body)) + body + audio)
        assert len(s.offsets) == 3 and s.skipped == 0
        return s.tags

    two = b"TT2" + (5).to_bytes(3, "big") + b"\0Name" + b"TXX" + (6).to_bytes(3, "big") + b"\0k\0val"
    assert tagged(2, 0, two + bytes(20)) == {"TT2": "Name", "k": "val"}
    wide = "﻿ÿþ".encode("utf-16-le")
    text = b"\x01" + wide
    three = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    assert tagged(3, 0x80, three.replace(b"\xff", b"\xff\x00")) == {"TIT2": "ÿþ"}
    extended = (6).to_bytes(4, "big") + bytes(6)
    assert tagged(3, 0x40, extended + three) == {"TIT2": "ÿþ"}
    plain = b"\x03" + "é".encode()
    four = b"TPE1" + syncsafe(len(plain) + 4) + b"\0\x01" + syncsafe(len(plain)) + plain
    assert tagged(4, 0x40, syncsafe(6) + b"\x01\0" + four) == {"TPE1": "é"}
    s = M.parse(b"ID3\x04\0\x10" + syncsafe(len(four)) + four + b"3DI\x04\0\x10" + syncsafe(len(four)) + audio)
    assert s.tags == {"TPE1": "é"} and s.skipped == 0


def test_ape_tags_at_both_ends():
    rng = random.Random(7)
    audio = b"".join(frame(rng, "MPEG 1 layer I stereo, 128 kbit/s at 44100") for _ in range(4))
    item = lambda k, v: len(v).to_bytes(4, "little") + bytes(4) + k + b"\0" + v

    def part(body, flags, items):
        return b"APETAGEX" + (2000).to_bytes(4, "little") + (len(body) + 32).to_bytes(4, "little") + items.to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)

    a, b = item(b"Title", "é".encode()) + item(b"Year", b"1999"), item(b"Mood", b"calm")
    old = b"TAG" + b"Old".ljust(124, b"\0") + b"\xff"
    end = part(a, 0xA0000000, 2) + a + part(a, 0x80000000, 2)
    s = M.parse(part(b, 0xA0000000, 1) + b + part(b, 0x80000000, 1) + audio + end + old)
    assert s.tags == {"Title": "é", "Year": "1999", "Mood": "calm", "id3v1": "Old"} and len(s.offsets) == 4 and s.skipped == 0


def test_encoder_delay_shortens_the_sound():
    rng = random.Random(8)
    kind = "MPEG 1 layer III stereo, 128 kbit/s at 44100"
    info = bytearray(frame(rng, kind))
    table = b"Info" + (15).to_bytes(4, "big") + (20).to_bytes(4, "big") + (9999).to_bytes(4, "big") + bytes(range(100)) + (50).to_bytes(4, "big")
    table += b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    info[36 : 36 + len(table)] = table
    s = M.parse(bytes(info) + b"".join(frame(rng, kind) for _ in range(20)))
    assert s.table["frames"] == 20 and s.table["encoder"] == "LAME3.100" and (s.table["delay"], s.table["padding"]) == (576, 1000)
    assert s.seconds == Fraction(20 * 1152 - 1576, 44100) and len(s.offsets) == 20


def test_own_streams_hold_what_the_format_says():
    data = bytes(range(256)) * 40
    stream = M.pack(data)
    s = M.parse(stream)
    assert s.table["bytes"] == len(stream) - s.offsets[0] + 192 - 128 and s.table["frames"] == len(s.offsets)
    at = s.offsets[0]
    for o, h in zip(s.offsets, s.headers):  # each frame says where the next is
        kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[stream[o + 2] >> 4]
        assert o == at and stream[o : o + 2] == b"\xff\xfa" and crc(stream[o + 2 : o + 4] + stream[o + 6 : o + 23]) == int.from_bytes(stream[o + 4 : o + 6], "big")
        at += 144 * kbps * 1000 // 48000
    assert at == len(stream) - 128 and s.seconds == Fraction(24 * len(s.offsets), 1000)
