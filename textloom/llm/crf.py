"""Exact forward-backward for linear chains, many sequences at once.

Sequences are cut into pieces of PIECE steps. The product of a piece's step matrices is its
transfer; passing vectors from piece to piece gives the exact message at each cut, and then
all pieces run forward and backward side by side. Work is linear in the number of words and
the Python steps don't grow with the longest sequence alone.
"""

from __future__ import annotations

import numpy as np

PIECE = 64


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def marginals(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
    """P(label of word | its whole sequence), (words, labels); with `pairs` also the
    expected number of each transition, summed over all sequences.

    `emission` has the log scores of all words, sequence after sequence, `counts` the words
    of each; sequences may be empty.
    """
    n, labels = emission.shape
    if not n:
        return (emission.copy(), np.zeros((labels, labels))) if pairs else emission.copy()
    step = np.exp(emission - emission.max(1, keepdims=True))
    move, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    counts = counts[counts > 0]
    per = -(-counts // PIECE)  # pieces of each sequence
    pieces = int(per.sum())
    owner = np.repeat(np.arange(len(counts)), per)
    opening = np.concatenate([[0], np.cumsum(per)[:-1]])
    nth = np.arange(pieces) - opening[owner]
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[owner] + nth * PIECE
    length = np.minimum(PIECE, counts[owner] - nth * PIECE)
    at = begin[:, None] + np.arange(PIECE)
    inside = np.arange(PIECE) < length[:, None]
    p = step[np.where(inside, at, 0)]
    is_first = nth == 0
    # Transfers: the first word of a sequence has no transition before it.
    transfer = np.broadcast_to(np.eye(labels), (pieces, labels, labels)).copy()
    for t in range(PIECE):
        on = inside[:, t]
        if not on.any():
            break
        moved = transfer @ move
        if t == 0:
            moved[is_first] = transfer[is_first]
        moved = moved * p[:, t, None, :]
        transfer = np.where(on[:, None, None], _scaled(moved, (1, 2)), transfer)
    # Messages at the cuts, for the nth piece of every sequence at once.
    into = np.empty((pieces, labels))
    back = np.ones((pieces, labels))
    into[opening] = first
    for k in range(1, int(per.max())):
        now = opening[per > k] + k
        into[now] = _scaled(np.einsum("si,sij->sj", into[now - 1], transfer[now - 1]), 1)
    for k in range(int(per.max()) - 2, -1, -1):
        now = opening[per > k + 1] + k
        back[now] = _scaled(np.einsum("sij,sj->si", transfer[now + 1], back[now + 1]), 1)
    forward, backward = np.empty((pieces, PIECE, labels)), np.empty((pieces, PIECE, labels))
    message, prior = into, np.empty((pieces, PIECE, labels)) if pairs else None
    for t in range(PIECE):
        if pairs:
            prior[:, t] = message
        moved = message @ move
        if t == 0:
            moved[is_first] = message[is_first]
        message = np.where(inside[:, t, None], _scaled(moved * p[:, t], 1), message)
        forward[:, t] = message
    message = back
    for t in range(PIECE - 1, -1, -1):
        backward[:, t] = message
        if t:
            message = np.where(inside[:, t, None], _scaled((message * p[:, t]) @ move.T, 1), message)
    both = forward * backward
    both /= np.maximum(both.sum(2, keepdims=True), 1e-300)
    out = both[inside]
    if not pairs:
        return out
    joint = prior[:, :, :, None] * move * (p * backward)[:, :, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    real = inside.copy()
    real[is_first, 0] = False
    return out, joint[real].sum(0)
