"""Characteristic polynomials of integer matrices, their real roots, and null vectors, without rounding.

Integers only: residues of the polynomial modulo many primes, the polynomial from
them, counts of roots by sign changes, bisection, and inverse iteration in fixed
point. Sizes depend on the matrix alone, never on how many rows it was made from.
"""

from __future__ import annotations

import math

import numpy as np

GUARD_BITS = 110  # of a root, relative to the largest one; roots closer than that count as one multiple root
FIXED_BITS = 192  # of a quotient in inverse iteration


def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**31, as many as it takes for their product to pass ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is larger (Maclaurin's inequality)."""
    return max(math.comb(size, k) * trace**k // size**k + 1 for k in range(size + 1))


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a ** (p - 2) modulo p; 0 for 0."""
    out, power, left = np.ones_like(a), a % p, p - 2
    while left.any():
        out = np.where(left & 1, out * power % p, out)
        power, left = power * power % p, left >> 1
    return out


def polynomial_residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo each prime, all primes at once."""
    size, p = len(matrix), np.array(primes, dtype=np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], dtype=np.int64).reshape(len(p), size, size)
    all_, p2, p3 = np.arange(len(p)), p[:, None], p[:, None, None]
    for m in range(1, size - 1):  # to Hessenberg form by similarity
        pivot = m + (h[:, m:, m - 1] != 0).argmax(axis=1)
        h[all_, m], h[all_, pivot] = h[all_, pivot], h[all_, m]
        h[all_, :, m], h[all_, :, pivot] = h[all_, :, pivot], h[all_, :, m]
        u = h[:, m + 1 :, m - 1] * _inverse(h[:, m, m - 1], p)[:, None] % p2
        h[:, m + 1 :, :] = (h[:, m + 1 :, :] - u[:, :, None] * h[:, m, None, :]) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p3).sum(axis=2)) % p2
    polys = np.zeros((size + 1, len(p), size + 1), dtype=np.int64)
    polys[0, :, 0] = 1
    for k in range(1, size + 1):
        last = polys[k - 1]
        out = -h[:, k - 1, k - 1, None] * last % p2
        out[:, 1:] = (out[:, 1:] + last[:, :-1]) % p2
        below = np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            out = (out - (below * h[:, i - 1, k - 1] % p)[:, None] * polys[i - 1]) % p2
        polys[k] = out
    return polys[size]


def combine(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The coefficients of least magnitude with the given residues (Chinese remainders)."""
    product = math.prod(primes)
    weights = [product // p * pow(product // p, -1, p) for p in primes]
    out = []
    for of_one in zip(*residues):
        value = sum(int(r) * w for r, w in zip(of_one, weights)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def _roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots, with multiplicity, exceed at / 2**bits: sign changes of the shifted polynomial.

    By Descartes' rule, which is exact where all roots are real.
    """
    size = len(poly) - 1
    c = [v << bits * (size - i) for i, v in enumerate(poly)]
    for first in range(size):
        for i in range(size - 1, first - 1, -1):
            c[i] += at * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, bits: int) -> int:
    size, value = len(poly) - 1, 0
    for i in range(size, -1, -1):
        value = value * at + (poly[i] << bits * (size - i))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(numerator, bits, multiplicity) of the largest positive roots, falling, at least ``count`` of them if there are.

    A root is numerator / 2**bits within the largest one times 2**-GUARD_BITS.
    All roots of ``poly`` must be real and none negative.
    """
    zeros = next(i for i, v in enumerate(poly) if v)
    poly = poly[zeros:]
    if len(poly) == 1:
        return []
    top = max(-poly[-2], 1).bit_length()  # all roots are at most their sum
    bits = max(GUARD_BITS - top, 0) + 8
    found, held = [], 0
    stack = [(0, 0, top, 0, len(poly) - 1)]  # (low / 2**b, b, width 2**w, roots above high, roots above low)
    while stack and held < count:
        low, b, w, above_high, above_low = stack.pop()
        if above_low == above_high:
            continue
        if above_low - above_high == 1 or w + bits <= 0:
            many = above_low - above_high
            found.append((*_bisected(poly, low, b, w, bits, many), many))
            held += many
            continue
        w -= 1
        deeper = max(b, -w)
        low <<= deeper - b
        middle = low + (1 << (w + deeper))
        above = _roots_above(poly, middle, deeper)
        stack.append((low, deeper, w, above, above_low))
        stack.append((middle, deeper, w, above_high, above))
    return found


def _bisected(poly: list[int], low: int, b: int, w: int, bits: int, many: int) -> tuple[int, int]:
    """The root in (low / 2**b, low / 2**b + 2**w] to ``bits`` fractional bits; the middle if it is a cluster."""
    low, width = low << (bits - b), 1 << (w + bits)
    if many > 1 or width <= 1:
        return low + width // 2, bits
    high = low + width
    if not (sign := _sign(poly, high, bits)):
        return high, bits
    while high - low > 1:
        middle = (low + high) // 2
        at = _sign(poly, middle, bits)
        if at == 0:
            return middle, bits
        low, high = (low, middle) if at == sign else (middle, high)
    return high, bits


def _start(size: int, seed: int) -> list[int]:
    state, out = 0x9E3779B97F4A7C15 + seed, []
    for _ in range(size):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(((state >> 11) - 2**52) << (FIXED_BITS - 52))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    """``v`` scaled to length 2**FIXED_BITS."""
    length = math.isqrt(int((v * v).sum())) or 1
    return (v << FIXED_BITS) // length


def null_vectors(matrix: list[list[int]], at: int, bits: int, many: int, rounds: int = 4) -> list[list[float]]:
    """Unit vectors, orthogonal to one another, that span the eigenvectors of the root at / 2**bits of multiplicity ``many``.

    Inverse iteration in fixed point; the factors are made once, with row exchanges.
    """
    size = len(matrix)
    a = np.array([[v << bits for v in row] for row in matrix], dtype=object).reshape(size, size)
    a[np.diag_indices(size)] -= at
    factors, order = np.zeros((size, size), dtype=object), np.arange(size)
    for k in range(size):
        best = k + int(np.argmax(abs(a[k:, k])))
        for rows in (a, factors, order):
            rows[[k, best]] = rows[[best, k]]
        a[k, k] = a[k, k] or 1
        factors[k + 1 :, k] = (a[k + 1 :, k] << FIXED_BITS) // a[k, k]
        a[k + 1 :, k:] -= (factors[k + 1 :, k, None] * a[None, k, k:]) >> FIXED_BITS
    vectors = [_unit(np.array(_start(size, seed), dtype=object)) for seed in range(many)]
    for _ in range(rounds):
        for n, v in enumerate(vectors):
            v = (v << bits)[order]
            for k in range(size):
                v[k + 1 :] -= (factors[k + 1 :, k] * v[k]) >> FIXED_BITS
            for k in range(size - 1, -1, -1):
                v[k] = (v[k] << FIXED_BITS) // a[k, k]
                v[:k] -= (a[:k, k] * v[k]) >> FIXED_BITS
            v = _unit(v)
            for other in vectors[:n]:
                v = v - ((other * (int((other * v).sum()) >> FIXED_BITS)) >> FIXED_BITS)
            vectors[n] = _unit(v)
    return [[int(x) / 2**FIXED_BITS for x in v] for v in vectors]
