"""Surface areas of the 256 ways in which the eight corners of a cube can lie inside or outside an object."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

#: The corners, in the order of their bits.
CORNERS = tuple(product((0, 1), repeat=3))


def _faces() -> list[list[int]]:
    """The corners of each face, in order around it."""
    out = []
    for axis in range(3):
        for side in (0, 1):
            ring = ((0, 0), (0, 1), (1, 1), (1, 0))
            out.append([CORNERS.index((*p[:axis], side, *p[axis:])) for p in ring])
    return out


def _loops(inside: list[bool]) -> list[list[tuple[int, int]]]:
    """Closed polygons through the middles of the edges between an inside and an outside corner.

    On each face, edges next to each other around an inside corner, or on either side of inside neighbours, are joined; so two inside corners
    that only touch across a face stay apart, on either side of that face alike.
    """
    links: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for face in _faces():
        edges = [tuple(sorted((face[i], face[(i + 1) % 4]))) for i in range(4)]
        crossed = [e for e in edges if inside[e[0]] != inside[e[1]]]
        if len(crossed) == 2:
            pairs = [tuple(crossed)]
        else:  # none, or four: about each inside corner its own two edges
            pairs = [tuple(e for e in crossed if c in e) for c in face if crossed and inside[c]]
        for a, b in pairs:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
    out = []
    while links:
        start = next(iter(links))
        loop, at = [start], links[start][0]
        links[at].remove(start)
        links[start].remove(at)
        while at != start:
            loop.append(at)
            nxt = links[at].pop()
            links[nxt].remove(at)
            at = nxt
        out.append(loop)
        links = {k: v for k, v in links.items() if v}
    return out


@lru_cache
def cube_areas(dz: float, dy: float, dx: float) -> tuple[float, ...]:
    """The area of the surface in a cube of 2 x 2 x 2 voxels, by the bits of its inside corners; polygons are cut into triangles about their middle."""
    size, out = (dz, dy, dx), []
    for code in range(256):
        total = 0.0
        for loop in _loops([bool(code >> i & 1) for i in range(8)]):
            points = [tuple((CORNERS[a][k] + CORNERS[b][k]) / 2 * size[k] for k in range(3)) for a, b in loop]
            middle = tuple(sum(p[k] for p in points) / len(points) for k in range(3))
            for i, p in enumerate(points):
                u, v = (tuple(q[k] - middle[k] for k in range(3)) for q in (p, points[i - 1]))
                cross = (u[i] * v[j] - u[j] * v[i] for i, j in combinations(range(3), 2))
                total += sum(c * c for c in cross) ** 0.5 / 2
        out.append(total)
    return tuple(out)
