"""Line diffs: shortest edit scripts in linear space (Myers 1986), and their hunks as unified diffs have them.

Lines that the other text lacks can't be matched and are set aside first, so that the search is over lines that both have.
"""

from __future__ import annotations

from itertools import pairwise

CONTEXT = 3


def _snake(a: list[int], b: list[int], x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int, int]:
    """(x, y, x, y) from where to where a stretch of equal symbols, maybe an empty one, lies in the middle of a shortest script for
    a[x0:x1] and b[y0:y1]: where paths from both ends, an edit longer each time, first overlap."""
    n, m = x1 - x0, y1 - y0
    odd, shift = (n - m) % 2, n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for mine, other, forward in ((ahead, back, True), (back, ahead, False)):
            for k in range(-d, d + 1, 2):
                x = mine[k + 1] if k == -d or k != d and mine[k - 1] < mine[k + 1] else mine[k - 1] + 1
                from_x, y = x, x - k
                if forward:
                    while x < n and y < m and a[x0 + x] == b[y0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[x1 - 1 - x] == b[y1 - 1 - y]:
                        x, y = x + 1, y + 1
                mine[k] = x
                if odd == forward and abs(shift - k) <= d - forward and x + other[shift - k] >= n:
                    return (x0 + from_x, y0 + from_x - k, x0 + x, y0 + y) if forward else (x1 - x, y1 - y, x1 - from_x, y1 - from_x + k)
    raise AssertionError("paths from both ends meet")


def _matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of the symbols that a shortest script keeps, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        while x0 < x1 and y0 < y1 and a[x0] == b[y0]:
            found.append((x0, y0))
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and a[x1 - 1] == b[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
            found.append((x1, y1))
        if x0 < x1 and y0 < y1:
            sx, sy, ex, ey = _snake(a, b, x0, x1, y0, y1)
            found += zip(range(sx, ex), range(sy, ey), strict=True)
            todo += [(x0, sx, y0, sy), (ex, x1, ey, y1)]
    return sorted(found)


def kept(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """(place before, place after) of the lines that stay."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (before, after))
    both = set(a) & set(b)
    at_a, at_b = ([i for i, x in enumerate(own) if x in both] for own in (a, b))
    return [(at_a[i], at_b[j]) for i, j in _matched([a[i] for i in at_a], [b[j] for j in at_b])]


def _span(start: int, stop: int) -> str:
    n = stop - start
    return f"{start + 1}" if n == 1 else f"{start + (n > 0)},{n}"


def hunks(before: str, after: str) -> list[dict]:
    """The changes with three lines around each; changes whose surroundings touch are one hunk."""
    if before == after:
        return []
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    stays = [(-1, -1), *kept(a, b), (len(a), len(b))]
    changes = [(i + 1, x, j + 1, y) for (i, j), (x, y) in pairwise(stays) if (x, y) != (i + 1, j + 1)]
    groups: list[list] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * CONTEXT:
            groups[-1].append(c)
        else:
            groups.append([c])
    found = []
    for group in groups:
        (i, _, j, _), (_, x, _, y) = group[0], group[-1]
        lead, tail = min(CONTEXT, i, j), min(CONTEXT, len(a) - x, len(b) - y)
        text, at = [], i - lead
        for c in group:
            text += [" " + line for line in a[at : c[0]]]
            text += ["-" + line for line in a[c[0] : c[1]]] + ["+" + line for line in b[c[2] : c[3]]]
            at = c[1]
        text += [" " + line for line in a[at : x + tail]]
        head = f"@@ -{_span(i - lead, x + tail)} +{_span(j - lead, y + tail)} @@"
        found.append({"old_start": i - lead, "old_lines": x + tail - i + lead, "new_start": j - lead, "new_lines": y + tail - j + lead, "text": head + "".join(text)})
    return found
