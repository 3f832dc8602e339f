import base64
import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import media_ogg as ogg
from attestra.llm.byte_bpe import Decoder, byte_bpe, load

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LOADED = load(PATH, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=80) | st.text(alphabet="ab'st \né中\U0001f469", max_size=200) | st.text(alphabet="a ", min_size=200, max_size=600))
@settings(deadline=None, max_examples=300)
def test_encoding_agrees(text):
    fst, decoder = LOADED
    text = text.encode("utf-8", "ignore").decode()
    packed = fst.encode(text)
    assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == TIKTOKEN.encode_ordinary(text)
    assert decoder.text(packed) == text


@given(st.binary(max_size=60), st.integers(1, 4))
@settings(deadline=None, max_examples=300)
def test_streaming_decoder_agrees_on_valid_prefixes(data, step):
    pieces = [data[i : i + step] for i in range(0, len(data), step)]
    got = "".join(Decoder(pieces).stream(range(len(pieces))))
    try:
        assert got == data.decode()
    except UnicodeDecodeError:
        assert "�" in got


def test_byte_bpe_rows(odd, odd_rows, none):
    rows = byte_bpe(odd, PATH, P.PATTERN, ids=True).collect()
    assert sorted(((r.doc_id, r.decoded) for r in rows), key=repr) == sorted(((r[0], r[1] or "") for r in odd_rows), key=repr)
    for r in rows:
        assert r.ids == TIKTOKEN.encode_ordinary(r.decoded) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert byte_bpe(none, PATH, P.PATTERN).collect() == []


def slow_crc(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    for n in (0, 1, 27, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [1, 254, 255, 256, 510, 0, 65_025], [255 * 255, 255 * 255 + 1, 3], [200_000, 5]])
def test_packets_survive_lacing(sizes):
    rng = random.Random(1)
    packets = [rng.randbytes(n) for n in sizes]
    w = ogg.Writer(9)
    total = 0
    for p in packets:
        total += len(p)
        w.packet(p, total)
    streams, bad = ogg.read(b"".join(w.close()))
    assert not bad and streams[9].packets == packets and streams[9].ended and not streams[9].lost and streams[9].granules[-1] == total


def test_damage_is_found_and_skipped():
    data = bytearray(ogg.write_pcm8(bytes(range(256)) * 1024, b"n"))
    first = data.find(b"OggS", 200)
    data[first + 400] ^= 1
    streams, bad = ogg.read(bytes(data))
    assert bad == 1 and sum(s.lost for s in streams.values()) >= 1
    with pytest.raises(ValueError):
        ogg.read_pcm8(bytes(data))
    assert ogg.read(b"")[0] == {} and ogg.read(b"OggS")[1] == 1


def test_media_rows(odd, odd_rows, none):
    rows = ogg.texts_as_ogg(odd, media=True).collect()
    texts = {}
    for i, t, *_ in odd_rows:
        texts.setdefault(i, []).append((t or "").encode())
    for r in rows:
        raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r.payload_bytes == len(payload) and r.media_bytes == len(r.media) and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert ogg.read_pcm8(bytes(r.media))[0] == payload
    assert len(rows) == len(odd_rows) and ogg.texts_as_ogg(none).collect() == []


def test_packets_of_a_column(spark):
    files = [(1, ogg.write_pcm8(b"x" * 8192, b"note")), (2, None), (3, b"junk")]
    rows = ogg.ogg_packets(spark.createDataFrame(files, "doc_id long, media binary"), "doc_id", "media").collect()
    assert {r.doc_id for r in rows} == {1} and sorted(len(r.bytes) for r in rows) == [4, 8, 16, 4096, 4096]
    assert max(r.end_us for r in rows) == 8192 * 1_000_000 // 8000
