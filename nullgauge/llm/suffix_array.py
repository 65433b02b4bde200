"""Suffix arrays by induced sorting, over numpy arrays.

Suffixes are classed as smaller (S) or larger (L) than their successor; leftmost-smaller (LMS) substrings are sorted
by inducing from their first symbols; their names make a shorter string, which is sorted by recursion; its order induces
all L suffixes from left to right and all S suffixes from right to left, in linear time.

A step takes as many neighbouring buckets at once as don't induce into each other, which is about the root of their
number where symbols are many; a run of one symbol, whose suffixes induce each other, is laid out at once: its suffixes
follow in order of their distance to the run's end, then of the ends.
"""

from __future__ import annotations

import numpy as np


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is S: its first change of symbol goes up. The last symbol is a unique smallest one."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    change = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    out = np.empty(n, bool)
    out[:-1] = step[np.minimum(nearest, n - 2)] > 0
    out[-1] = True
    return out


def _scatter(sa: np.ndarray, heads: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, way: int) -> None:
    """Puts suffixes, in order, at the heads of their symbols' buckets; way 1 fills up, -1 down."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    size = np.diff(np.append(first, len(order)))
    rank = np.arange(len(order)) - np.repeat(first, size)
    sa[heads[sorted_symbols] + way * rank] = suffixes[order]
    heads[sorted_symbols[first]] += way * size


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of consecutive ranges."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _with_runs(tails: np.ndarray, bucket: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at the ends of runs, in order within their buckets, and all other suffixes of the runs after them."""
    length = run[tails]
    if not len(tails) or length.max() == 1:
        return tails, bucket
    each = np.repeat(np.arange(len(tails)), length)
    back = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    order = np.lexsort((each, back, bucket[each]))
    return (tails[each] - back)[order], bucket[each][order]


#: Suffixes in the buckets that a step tries, unless its first bucket holds more.
STEP = 8192


def _scan(s: np.ndarray, sa: np.ndarray, run: np.ndarray, wanted: np.ndarray, heads: np.ndarray, edges: np.ndarray, size: np.ndarray, more: np.ndarray, more_at: np.ndarray, more_n: np.ndarray, way: int) -> None:
    """Induces one type of suffix. Buckets are taken from the first to the last (way 1) or back (way -1).

    wanted: suffixes of the type; heads: the next free place of each bucket, edges: the first one. more[more_at[c]:][:more_n[c]]:
    the other suffixes of bucket c that induce, in the order of `way`.
    """
    k = len(heads)
    upto = np.cumsum(size[::way])
    done, width = 0, 64
    while done < k:
        last = min(done + width, max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + STEP, "right"))))
        # numbers along the way; c are symbols
        step = np.arange(done, last)
        c = step if way == 1 else k - 1 - step
        count = way * (heads[c] - edges[c])
        place = edges[c]
        tails = sa[np.repeat(place, count) + way * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))]
        own, own_step = _with_runs(tails, np.repeat(step, count), run)
        rest, rest_step = more[_ranges(more_at[c], more_n[c])], np.repeat(step, more_n[c])
        every, at = np.concatenate((own, rest)), np.concatenate((own_step, rest_step))
        order = np.argsort(at, kind="stable")
        every, at = every[order], at[order]
        some = every > 0
        before, at = every[some] - 1, at[some]
        target = s[before]
        some = wanted[before] & (target != s[before + 1])
        before, at, target = before[some], at[some], target[some]
        to = target if way == 1 else k - 1 - target
        # a bucket may be taken if none before it in this step, nor itself, induces into it or an earlier one
        nearest = np.full(last - done, k)
        np.minimum.at(nearest, at - done, to)
        fine = np.minimum.accumulate(nearest) > step
        end = last if fine.all() else done + int(np.argmin(fine))
        if len(own) > len(tails):
            size = np.bincount(own_step - done, minlength=last - done)
            cut = own_step < end
            sa[np.repeat(place, size)[cut] + way * (np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size))[cut]] = own[cut]
            taken = step < end
            heads[c[taken]] = edges[c[taken]] + way * size[taken]
        cut = at < end
        _scatter(sa, heads, target[cut], before[cut], way)
        width = max(16, min(2 * width if end == last else 2 * (end - done), 1 << 16))
        done = end


def _induce(s: np.ndarray, small: np.ndarray, run: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array that a list of LMS suffixes, in order within equal first symbols, induces."""
    n = len(s)
    ends = np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(s[lms], minlength=len(size))
    large = starts.copy()
    _scan(s, sa, run, ~small, large, starts, size, lms[np.argsort(s[lms], kind="stable")], np.cumsum(counts) - counts, counts, 1)
    inside = large - starts
    back = sa[_ranges(starts, inside)][::-1]
    before = np.cumsum(inside[::-1])[::-1] - inside
    _scan(s, sa, run, small, ends - 1, ends - 1, size, back, before, inside, -1)
    if sa[0] < 0:
        sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of symbols s >= 1, without the end mark that is added inside."""
    s = np.append(s.astype(np.int32), 0)
    n = len(s)
    if n == 1:
        return np.zeros(0, np.int64)
    small = _smaller(s)
    lms = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])))
    size = np.bincount(s)
    change = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    run = np.arange(n) - np.repeat(change, np.diff(np.append(change, n))) + 1
    sa = _induce(s, small, run, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # equal LMS substrings get equal names: same length, symbols and end
    following = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = following - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    depth, todo = 0, np.flatnonzero(same)
    while len(todo):
        todo = todo[length[a[todo]] > depth]
        if not len(todo):
            break
        # few pairs are compared over many symbols at once; a symbol past the end is compared as the last one
        wide = np.arange(depth, depth + max(1, 1 << 14 >> int(len(todo)).bit_length()))
        at = np.minimum(wide[None, :], length[a[todo]][:, None] - 1)
        differ = (s[a[todo][:, None] + at] != s[b[todo][:, None] + at]).any(1)
        same[todo[differ]] = False
        todo = todo[~differ]
        depth += len(wide)
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    names = name[lms]
    if len(names) > 1 and names.max() < len(names) - 1:
        order = lms[suffix_array(names + 1)]
    return _induce(s, small, run, order, size)[1:]


def reaches(s: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether its common prefix with a neighbour in the suffix array reaches `length`.

    Permuted common prefixes: positions are taken in text order, where neighbours stay at the same distance over long
    alignments. Prefixes are compared past the last position of an alignment only; at the others they end at the
    alignment's next difference or run on to there. Steps are of whole arrays.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    position = np.arange(n)
    shift = np.where(before < 0, 2 * n, before - position)
    # an alignment: consecutive positions with the same distance to their neighbour
    heads = np.flatnonzero(np.concatenate(([True], shift[1:] != shift[:-1])))
    tails = np.append(heads[1:], n) - 1
    live = before[heads] >= 0
    heads, tails = heads[live], tails[live]
    # the symbols that agree from a tail on, at most `length`
    agree = np.zeros(len(heads), np.int64)
    todo = np.arange(len(heads))
    other = before[tails]
    depth = 0
    while len(todo) and depth < length:
        i, j = tails[todo] + depth, other[todo] + depth
        inside = (i < n) & (j < n)
        todo = todo[inside]
        equal = s[i[inside]] == s[j[inside]]
        todo = todo[equal]
        depth += 1
        agree[todo] = depth
    # at an earlier position the prefix ends at the alignment's next difference, or runs on past its tail
    span = tails - heads + 1
    at = np.arange(span.sum()) + np.repeat(heads - np.cumsum(span) + span, span)
    last = np.repeat(tails, span)
    difference = np.where(s[at] != s[before[at]], at, n)
    following = np.minimum.accumulate(difference[::-1])[::-1]
    common = np.where(following <= last, following, np.repeat(agree + tails, span)) - at
    reach = np.zeros(n, bool)
    hit = at[common >= length]
    reach[hit] = True
    reach[before[hit]] = True
    return reach
