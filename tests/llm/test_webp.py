import numpy as np
import pytest

from gaugeworks.llm import webp


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (33, 40)])
@pytest.mark.parametrize("colours", [1, 2, 4, 9, 100, None])
def test_every_tool_round_trips(shape, colours):
    rng = np.random.default_rng(3)
    px = rng.integers(0, 2**32, shape, dtype=np.uint32) if colours is None else rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, shape)]
    tools = [{}, {"subtract_green": True}, *[{"predictor": m} for m in range(14)], {"cross": 0xF0E0D0, "predictor": 12, "subtract_green": True}, {"cache_bits": 5}, {"back_references": True}, {"cache_bits": 3, "back_references": True}]
    if colours:
        tools += [{"palette": True}, {"palette": True, "predictor": 11, "back_references": True}]
    for kw in tools:
        assert (webp.load(webp.encode(px, **kw))[0] == px).all(), kw


@pytest.mark.parametrize("n", [64, 128, 6400, 65536, 64 * 3001])
def test_payloads_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    for payload in (data, b"\0" * n, (b"the of and tion er\n" * n)[:n]):
        assert webp.samples_of(webp.load(webp.store(payload))) == payload


def test_long_payloads_become_strips():
    payload = b"ab" * (webp.STRIP_BYTES // 2 + 64)
    assert len(webp.load(webp.store(payload))) == 2 and webp.samples_of(webp.load(webp.store(payload))) == payload


def test_broken_streams_are_refused():
    blob = webp.store(b"x" * 64)
    for bad in (blob[:30], b"JUNK" + blob[4:], blob[:20] + b"\0" + blob[21:]):
        with pytest.raises((webp.WebPError, IndexError)):
            webp.load(bad)


def test_neighbour_rule():
    assert len(webp.NEIGHBOURS) == 120 and webp.NEIGHBOURS[:3] == [(0, 1), (1, 0), (1, 1)] and webp.NEIGHBOURS[-1] == (8, 7)


@pytest.mark.parametrize(("tool", "payload"), [
    ("back_references", b"".join(b"line %d of a poem\n" % (k % 9) for k in range(900))),
    ("palette", bytes(np.array([b"aaaa", b"bbbb", b"abab"])[np.random.default_rng(1).integers(0, 3, 4000)].tobytes())),
    ("predictor", np.random.default_rng(2).integers(0, 3, (3000, 4), dtype=np.uint8).cumsum(axis=0, dtype=np.uint8).tobytes()),
    ("cross", (np.random.default_rng(3).integers(0, 256, (3000, 1), dtype=np.uint8) * np.array([[1, 1, 2, 0]], dtype=np.uint8)).tobytes()),
    ("subtract_green", (np.random.default_rng(4).integers(0, 256, (3000, 2), dtype=np.uint8)[:, [0, 0, 0, 1]]).tobytes()),
])
def test_payloads_are_written_with_the_tools_that_pay(tool, payload):
    payload += b"\0" * (-len(payload) % 64)
    samples = np.frombuffer(payload, dtype=np.uint8)
    four = samples.reshape(-1, 4).astype(np.uint32)
    tools = webp.choose(four[:, 3] << 24 | four[:, 0] << 16 | four[:, 1] << 8 | four[:, 2], webp._literal_bits(samples))
    assert tool in tools
    blob = webp.store(payload)
    assert len(blob) < len(webp._strip(samples)) and webp.samples_of(webp.load(blob)) == payload


def _stream(*fields: tuple[int, int]) -> bytes:
    """Fields (value, bits) from the low end of each byte."""
    value = n = 0
    for v, bits in fields:
        value |= v << n
        n += bits
    return value.to_bytes((n + 7) // 8, "little")


HEAD = ((0x2F, 8),)
ONE = lambda symbol: ((1, 1), (0, 1), (1, 1), (symbol, 8))  # noqa: E731  a simple code of one symbol of 8 bits
TWO = lambda a, b: ((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))


def test_streams_put_together_by_hand_from_the_specification():
    """Bits written from the text of RFC 9649, not by this library's encoder."""
    size = lambda w, h: ((w - 1, 14), (h - 1, 14), (0, 1), (0, 3))
    plain = (*HEAD, *size(2, 1), (0, 1), (0, 1), (0, 1))  # no transform, no cache, no meta codes
    # green of two symbols (one bit a pixel), the other channels of one symbol each
    got = webp.decode_vp8l(_stream(*plain, *TWO(0x10, 0x20), *ONE(0x33), *ONE(0x44), *ONE(0xFF), *ONE(0), (0, 1), (1, 1)))
    assert got.tolist() == [[0xFF331044, 0xFF332044]]
    # subtract green: green is added to red and blue
    got = webp.decode_vp8l(_stream(*HEAD, *size(2, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *TWO(0x10, 0x20), *ONE(0xF8), *ONE(0x01), *ONE(0xFF), *ONE(0), (0, 1), (1, 1)))
    assert got.tolist() == [[0xFF081011, 0xFF182021]]
    # predictor: the first pixel is predicted black, the first row from the left, the first column from above; tile mode 2 (top)
    modes = ((0, 3), (0, 1), *ONE(2), *ONE(0), *ONE(0), *ONE(255), *ONE(0))
    got = webp.decode_vp8l(_stream(*HEAD, *size(2, 2), (1, 1), (0, 2), *modes, (0, 1), (0, 1), (0, 1), *TWO(1, 3), *ONE(0), *ONE(0), *ONE(0), *ONE(0), (0, 1), (1, 1), (1, 1), (0, 1)))
    assert got.tolist() == [[0xFF000100, 0xFF000400], [0xFF000400, 0xFF000500]]
    # cross-colour: green to red 1.0 (32 / 32): red gains the signed green
    element = ((0, 3), (0, 1), *ONE(0), *ONE(0), *ONE(32), *ONE(255), *ONE(0))
    got = webp.decode_vp8l(_stream(*HEAD, *size(2, 1), (1, 1), (1, 2), *element, (0, 1), (0, 1), (0, 1), *TWO(0x10, 0xF0), *ONE(0x20), *ONE(0x05), *ONE(0xFF), *ONE(0), (0, 1), (1, 1)))
    assert got.tolist() == [[0xFF301005, 0xFF10F005]]
    # palette of two colours (deltas), eight pixels a byte of green, lowest bit first
    colours = ((0, 1), *TWO(0x10, 0x20), *ONE(0x01), *ONE(0x02), *ONE(0x7F), *ONE(0), (0, 1), (1, 1))
    got = webp.decode_vp8l(_stream(*HEAD, *size(3, 1), (1, 1), (3, 2), (1, 8), *colours, (0, 1), (0, 1), (0, 1), *ONE(0b101), *ONE(0), *ONE(0), *ONE(255), *ONE(0)))
    assert got.tolist() == [[0xFE023004, 0x7F011002, 0xFE023004]]


def test_a_file_of_another_encoder():
    """The alpha plane of a file that comes with Python's own tests: a stream without header in an ALPH chunk."""
    test = pytest.importorskip("test.test_email")
    from pathlib import Path

    path = Path(test.__file__).parent / "data" / "python.webp"
    if not path.exists():
        pytest.skip("Python's test data are not installed")
    data = path.read_bytes()
    at = data.index(b"ALPH")
    body = data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    assert body[0] & 3 == 1  # lossless
    r = webp.Reader(body[1:])
    alpha = webp.decode_stream(r, 16, 16) >> 8 & 255
    assert alpha.shape == (16, 16) and 0 <= r.end - r.at < 32
    drawn = ["".join("#" if v > 128 else "." if v == 0 else "+" for v in row) for row in alpha]
    assert drawn[0] == "....#######++..." and drawn[4] == "###########+###+" and drawn[13] == "....#######+++++"  # the upper and the lower half of the logo
