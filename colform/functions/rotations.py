"""Axis-aligned rotations and packed quaternions."""

from __future__ import annotations

import math
from itertools import product

#: Largest absolute value of the three kept components, and steps of a component.
_RANGE = 2 / math.sqrt(2)
_STEPS = 1023


def axis_rotations() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """Images of the x and y axes for the 24 rotations of a cube, numbered from 1.

    The x image runs over +x, -x, +y, -y, +z, -z; for each the y image runs over the perpendicular axes in the same order.
    """
    axes = [tuple(s if i == k else 0 for i in range(3)) for k in range(3) for s in (1, -1)]
    return [(a, b) for a, b in product(axes, axes) if not any(x and y for x, y in zip(a, b))]


def rotation_id(x_image, y_image, tolerance: float = 1e-4) -> int:
    """Number of the axis-aligned rotation within ``tolerance``, 0 for none."""
    for number, (a, b) in enumerate(axis_rotations(), 1):
        if all(abs(p - q) <= tolerance for p, q in zip((*x_image, *y_image), (*a, *b))):
            return number
    return 0


def pack_quaternion(q: tuple[float, float, float, float]) -> int:
    """32 bits: the index of the largest component in the top two, then ten bits for each of the others."""
    norm = math.sqrt(sum(c * c for c in q))
    if not norm:
        raise ValueError("a zero quaternion is no rotation")
    q = tuple(c / norm for c in q)
    largest = max(range(4), key=lambda i: abs(q[i]))
    sign = -1 if q[largest] < 0 else 1
    out = largest
    for i, c in enumerate(q):
        if i != largest:
            step = math.floor((sign * c / _RANGE + 0.5) * _STEPS + 0.5)
            out = out << 10 | min(max(step, 0), _STEPS)
    return out


def unpack_quaternion(packed: int) -> tuple[float, float, float, float]:
    largest = packed >> 30
    rest = [((packed >> shift & 1023) / _STEPS - 0.5) * _RANGE for shift in (20, 10, 0)]
    missing = math.sqrt(max(0.0, 1 - sum(c * c for c in rest)))
    return tuple(rest[:largest] + [missing] + rest[largest:])
