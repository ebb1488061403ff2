import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import chunking
from siltstone.functions.chunking import ChunkOptions, cut, gear_table

GEAR = gear_table()


def scalar(data, o):
    """The same cuts a byte at a time."""
    out, p, gear = [], 0, [int(x) for x in GEAR]
    while p < len(data):
        rest = data[p:]
        if len(rest) <= o.min_size:
            out.append((len(rest), 0))
            break
        n, fp, end = min(len(rest), o.max_size), 0, None
        for i in range(o.min_size, n):
            fp = ((fp << 1) + gear[rest[i]]) & (2**64 - 1)
            if fp & (o.strict if i < o.avg_size else o.loose) == 0:
                end = i + 1
                break
        out.append((end or n, fp))
        p += end or n
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([(256, 2), (300, 2), (64, 0), (256, 4), (1024, 2)]))
def test_cuts_are_those_of_the_scalar_definition(data, how):
    avg, norm = how
    o = ChunkOptions(avg, normalization=norm, min_size=64 if avg == 64 else 0, max_size=128 if avg == 64 else 0) if avg > 64 else ChunkOptions(avg, 64, 128, norm)
    if avg > 64 and avg // 4 < 64:
        o = ChunkOptions(avg, 64, avg * 4, norm)
    lengths, prints = cut(np.frombuffer(data, np.uint8), o, GEAR)
    assert list(zip(lengths.tolist(), map(int, prints), strict=True)) == scalar(data, o)
    assert lengths.sum() == len(data)


@pytest.mark.parametrize("text", [b"Testing chunk size bounds with FastCDC algorithm. " * 200, b"ABCDEFGHIJ" * 10000])
def test_bounds(text):
    lengths, _ = cut(np.frombuffer(text, np.uint8), ChunkOptions(256), GEAR)
    assert lengths.sum() == len(text) and lengths.max() <= 1024 and lengths[:-1].min() >= 64


def test_most_chunks_survive_an_inserted_prefix():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000, np.uint8).tobytes()

    def pieces(x):
        lengths, _ = cut(np.frombuffer(x, np.uint8), ChunkOptions(256), GEAR)
        ends = np.cumsum(lengths)
        return {x[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)}

    base, moved = pieces(data), pieces(b"PREPENDED CONTENT: " + data)
    assert len(base & moved) > 0.9 * len(base)


@pytest.mark.parametrize("bad", [dict(avg_size=10), dict(avg_size=256, min_size=512), dict(avg_size=256, normalization=5), dict(avg_size=1 << 31)])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        ChunkOptions(**bad)


def test_bits_round_half_up():
    assert [ChunkOptions(a).bits for a in (256, 300, 363, 1024)] == [8, 8, 9, 10]


@pytest.mark.parametrize("block", [64, 100, 1000])
def test_blocks_change_no_cut(monkeypatch, block):
    data = np.random.default_rng(4).integers(0, 256, 20_000).astype(np.uint8)
    data[5000:9000] = 7
    o = ChunkOptions(256)
    want = [x.tolist() for x in cut(data, o, GEAR)]
    monkeypatch.setattr(chunking, "BLOCK", block)
    assert [x.tolist() for x in cut(data, o, GEAR)] == want
    assert list(zip(*want, strict=True)) == scalar(data.tobytes(), o)


def test_memory_does_not_grow_with_the_value():
    import tracemalloc

    data = np.random.default_rng(5).integers(0, 256, 24 << 20).astype(np.uint8)
    tracemalloc.start()
    assert cut(data, ChunkOptions(65536), GEAR)[0].sum() == len(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
