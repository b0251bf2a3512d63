"""Re-Pair grammars of many token sequences at once.

The sequences of a batch lie one after another in one array. In every round each sequence's adjacent pairs are
counted, and every pair that occurs at least twice and more often than the pairs it overlaps is replaced by the rule
that stands for it; a sequence is finished when no pair of it can be replaced. Rules are inferred for each
sequence on its own. All steps are sorts and gathers over the unfinished part of the batch.
"""

from __future__ import annotations

import numpy as np


def dense(fid: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """Symbols renumbered 0, 1, ... within each sequence; ``fid`` is sorted."""
    order = np.lexsort((sym, fid))
    f, s = fid[order], sym[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])] if len(f) else np.empty(0, bool)
    rank = np.cumsum(new) - 1
    first = np.r_[True, f[1:] != f[:-1]] if len(f) else np.empty(0, bool)
    base = np.maximum.accumulate(np.where(first, rank, 0))
    out = np.empty(len(sym), np.int64)
    out[order] = rank - base
    return out


def _ranked(fid: np.ndarray, sym: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of adjacent pairs by sequence and symbols, and whether each in that order differs from the one before."""
    bits = max(1, int(sym.max()).bit_length())
    code = np.where(pair, (sym[:-1] << bits) | sym[1:], 0)
    owner = np.where(pair, fid[:-1], -1)
    if 2 * bits + int(fid[-1] + 1).bit_length() < 63:
        key = ((owner + 1) << (2 * bits)) | code
        order = np.argsort(key, kind="stable")
        k = key[order]
        return order, np.r_[True, k[1:] != k[:-1]]
    order = np.lexsort((code, owner))
    k, o = code[order], owner[order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]


def infer(fid: np.ndarray, sym: np.ndarray, n: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``fid`` (sorted, below ``n``) and dense symbols to (rule's sequence, uses, expansion, first position, final length of each sequence).

    ``uses`` counts replacements of the rule, ``expansion`` the tokens it stands for, and ``first position`` is the
    index of the first token of its first use.
    """
    top = np.zeros(n, np.int64)
    np.maximum.at(top, fid, sym + 1)
    span = np.ones(len(sym), np.int64)
    at = np.arange(len(sym))
    rules: list[tuple[np.ndarray, ...]] = []
    final = np.bincount(fid, minlength=n)
    while len(sym) > 1:
        pair = fid[1:] == fid[:-1]
        order, new = _ranked(fid, sym, pair)
        group = np.cumsum(new) - 1
        counts = np.bincount(group)
        of = np.empty(len(pair), np.int64)
        of[order] = group
        c = np.where(pair, counts[of], 0)
        left, right = np.r_[0, c[:-1]], np.r_[c[1:], 0]
        # a tie goes to the pair on the left, then to every second pair of a run of ties
        win = (c >= least) & (c >= right) & (c > left)
        tie = (c >= least) & (c >= right) & (c == left)
        run_start = np.flatnonzero(~tie)
        dist = np.arange(len(c)) - np.maximum.accumulate(np.where(tie, 0, np.arange(len(c)))) if len(run_start) else np.zeros(len(c), np.int64)
        win |= tie & (dist % 2 == 0)
        win &= ~np.r_[False, win[:-1]]
        if not win.any():
            break
        uses = np.bincount(of[win], minlength=len(counts))
        # a rule used once saves nothing
        win &= uses[of] >= least
        if not win.any():
            break
        pos = np.flatnonzero(win)
        g = of[pos]
        used, firsts, back, uses = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
        owner = fid[pos[firsts]]
        start = np.r_[True, owner[1:] != owner[:-1]]
        number = np.arange(len(used)) - np.maximum.accumulate(np.where(start, np.arange(len(used)), 0))
        name = top[owner] + number
        np.maximum.at(top, owner, name + 1)
        width = span[pos] + span[pos + 1]
        rules.append((owner, uses, width[firsts], at[pos[firsts]]))
        sym = sym.copy()
        sym[pos] = name[back]
        span = span.copy()
        span[pos] = width
        keep = np.ones(len(sym), bool)
        keep[pos + 1] = False
        fid, sym, span, at = fid[keep], sym[keep], span[keep], at[keep]
        left = np.bincount(fid, minlength=n)
        active = np.zeros(n, bool)
        active[owner] = True
        final[active] = left[active]
        keep = active[fid]
        fid, sym, span, at = fid[keep], sym[keep], span[keep], at[keep]
    if not rules:
        z = np.empty(0, np.int64)
        return z, z, z, z, final
    return (*(np.concatenate(x) for x in zip(*rules)), final)
