import numpy as np
import pytest

from quantloom.llm import media, webp


def back(pixels, **how):
    out = webp.decode_webp(webp.encode_webp(pixels, **how))
    assert out.shape == pixels.shape and (out == pixels).all()


@pytest.mark.parametrize("seed", range(6))
def test_every_transform_round_trips(seed):
    rng = np.random.default_rng(seed)
    for _ in range(4):
        h, w = rng.integers(1, 40, 2)
        few = rng.integers(0, 2**32, rng.integers(1, 300), dtype=np.uint64).astype(np.uint32)
        pixels = few[rng.integers(0, len(few), (h, w))]
        step = int(rng.integers(2, 6))
        blocks = (-(-h // (1 << step)), -(-w // (1 << step)))
        modes, colours = rng.integers(0, 14, blocks), rng.integers(0, 256, (*blocks, 3))
        back(pixels)
        back(pixels, subtract_green=True)
        back(pixels, cache_bits=int(rng.integers(1, 12)))
        back(pixels, references=True, cache_bits=5)
        back(pixels, predictor=modes, step=step, references=True)
        back(pixels, cross_colour=colours, step=step)
        back(pixels, predictor=modes, cross_colour=colours, subtract_green=True, step=step, cache_bits=4)
        if len(np.unique(pixels)) <= 256:
            back(pixels, palette=True, references=True)


def test_fast_and_slow_decoding_agree(monkeypatch):
    rng = np.random.default_rng(1)
    pixels = webp.ALPHA | rng.integers(0, 40, (50, 64)).astype(np.uint32) * np.uint32(0x010203)
    streams = [webp.encode_webp(pixels, references=r, cache_bits=c) for r in (False, True) for c in (0, 6)]
    for size in (1 << 18, 1 << 10):
        monkeypatch.setattr(webp, "WINDOW_BITS", size)
        assert all((webp.decode_webp(s) == pixels).all() for s in streams)
    monkeypatch.setattr(webp, "_fast_tokens", lambda bits, group, out, width, cache_bits: webp._slow_tokens(bits, [group], None, 0, out, width, cache_bits))
    assert all((webp.decode_webp(s) == pixels).all() for s in streams)


def test_entropy_image_with_two_groups():
    """Hand-made: two code groups chosen by 4 x 4 blocks; each group has single-symbol codes."""
    bits = webp.BitWriter()
    for value, n in ((0x2F, 8), (7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        bits.put(value, n)
    webp._put_pixels(bits, np.array([[0, 1 << 8]], np.uint32) | webp.ALPHA, False)
    for green in (5, 9):
        for symbol in (green, 1, 2, 255, 0):
            lengths = np.zeros(280 if symbol == green else 256, np.int64)
            lengths[symbol] = 1
            webp._put_code(bits, lengths)
    pixels = webp.decode_vp8l(bits.bytes())
    assert pixels[0, 0] == 0xFF010502 and pixels[3, 7] == 0xFF010902


def test_broken_data_raises():
    good = webp.encode_webp(np.full((4, 4), 0xFF123456, np.uint32))
    with pytest.raises(webp.WebPError):
        webp.decode_webp(b"RIFX" + good[4:])
    with pytest.raises(webp.WebPError):
        webp.decode_vp8l(b"\x2e" + bytes(30))


@pytest.mark.parametrize("payload", [b"", b"x", b"a" * 192, bytes(range(256)) * 7, "déjà vu".encode() * 99])
def test_store_and_load(payload):
    padded = media.pad(payload)
    assert len(padded) % 192 == 0 and padded and media.load(media.store(padded)) == padded


def test_long_payload_takes_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 4)
    padded = media.pad(b"some words " * 300)
    assert len(list(webp.decode_all(media.store(padded)))) > 1 and media.load(media.store(padded)) == padded


def test_frames(spark):
    rows = spark.createDataFrame([(1, "abc", 5), (1, "abc", 6), (2, None, 7), (3, "", 8), (None, "x" * 70000, 9)], "doc_id long, text string, pixels int")
    out = {(r["doc_id"], r["n_bytes"]): r for r in media.media_digest(rows).collect()}
    assert len(out) == 4 and out[(2, 0)]["payload_sha256"] == out[(3, 0)]["payload_sha256"] and out[(2, 0)]["payload_bytes"] == 192
    images = media.decode_media(media.encode_media(rows)).collect()
    assert len(images) == 5 and all(r["width"] == 64 and len(r["pixels"]) == 64 * r["height"] for r in images)
    assert media.media_digest(rows.limit(0)).count() == 0


def test_every_way_of_coding_is_chosen_and_read_back():
    """Payloads that each way suits; the decoder's parts run on what store() wrote."""
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(600)]
    slope = (np.arange(64 * 64) % 251)[:, None] + rng.integers(0, 3, (64 * 64, 3))
    grey = rng.integers(0, 256, (64 * 64, 1)) + rng.integers(0, 4, (64 * 64, 3))
    cases = {
        "palette": b"ab " * 4000,
        "references": b"".join(words) * 2 + bytes(rng.integers(32, 127, 100, dtype=np.uint8)),
        "cache_bits": b"".join(words[i][:3] for i in rng.integers(0, 600, 9000)),
        "predictor": slope.astype(np.uint8).tobytes(),
        "subtract_green": grey.astype(np.uint8).tobytes(),
        "literals": bytes(rng.integers(0, 256, 5000, dtype=np.uint8)),
    }
    for way, payload in cases.items():
        used: list[str] = []
        padded = media.pad(payload)
        stored = media.store(padded, used)
        assert way in used[0].split("+"), (way, used)
        assert media.load(stored) == padded


def test_tokens_of_caches_and_references_agree_with_slow_reading():
    """Long streams of copies and cached colours, over several windows of the fast reader."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 24, 700, dtype=np.uint32) | np.uint32(0xFF000000)
    pixels = base[np.concatenate([rng.integers(0, 700, 9000), np.arange(600), np.arange(500), rng.integers(0, 40, 6284)])].reshape(-1, 64)
    for how in ({"cache_bits": 4}, {"cache_bits": 10}, {"references": True}, {"cache_bits": 7, "references": True}):
        assert (webp.decode_webp(webp.encode_webp(pixels, **how)) == pixels).all()
