"""What a truncated conversation is, by definition (small inputs only)."""
from itertools import accumulate, takewhile


def words(text):
    return len((text or "").split()) + 1


def truncate(history, limit):
    """(kept, overflow): the first turn and the longest tail of the others that
    fits with it; the last turn stays whether it fits or not."""
    first, rest = history[0], history[1:]
    if not rest:
        return list(history), words(first[1]) > limit
    from_end = accumulate(words(x) for _, x in reversed(rest))
    n = sum(1 for _ in takewhile(lambda size: words(first[1]) + size <= limit, from_end))
    return [first, *rest[len(rest) - max(n, 1):]], n == 0


def context_replay(rows, limit):
    """rows: [(turn, role, text)] in order; {user turn: (first kept, turns sent,
    words, status)} of the conversation up to it. With one limit, a turn that
    did not fit once never fits later, so each prefix can be looked at alone."""
    out = {}
    for n, (turn, role, _) in enumerate(rows):
        if role == "user":
            kept, over = truncate([(t, x) for t, _, x in rows[:n + 1]], limit)
            out[turn] = (kept[1][0] if n else None, len(kept), sum(words(x) for _, x in kept),
                         "overflow" if over else "ok")
    return out
