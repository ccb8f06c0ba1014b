import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kairoframe.llm import bytetext as B


def by_definition(raw):
    values = [sum(int(B.BYTE_VALUES[k][c]) * pow(B.BASES[k], i, B.PRIME) for i, c in enumerate(raw)) % B.PRIME for k in (0, 1)]
    return B.mix(np.array([values[0] << 31 | values[1]], np.uint64))[0]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.data())
def test_range_hash_is_the_polynomial_of_its_bytes(raw, data):
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    assert B.RangeHash(np.frombuffer(raw, np.uint8))(np.array([a]), np.array([b]))[0] == by_definition(raw[a:b])


def test_ranges_over_many_blocks():
    raw = np.random.default_rng(3).integers(0, 256, 5 * B.BLOCK + 7).astype(np.uint8)
    hashed = B.RangeHash(raw)
    starts = np.array([0, 1, B.BLOCK - 1, B.BLOCK, 4 * B.BLOCK + 5])
    ends = np.minimum(starts + np.array([3, 400, 2, 1000, 700]), len(raw))
    assert hashed(starts, ends).tolist() == [by_definition(raw[a:b].tobytes()) for a, b in zip(starts, ends)]


def thue_morse(n):
    line = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return line, line.translate(str.maketrans("ab", "ba"))


def test_strings_that_collide_modulo_powers_of_two_are_told_apart():
    for n in (1024, 4096):
        one, two = thue_morse(n)
        h = B.RangeHash(np.frombuffer((one + two).encode(), np.uint8))(np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]


def test_shingles_of_few_words():
    value, out = B.shingles(*B.text_bytes(pa.array(["a b", "A  b", "", None, "a b c d"])), 3)
    assert np.diff(out).tolist() == [1, 1, 0, 0, 2] and value[0] == value[1]
