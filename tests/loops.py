"""Plain dictionary loops over ordered rows, written from the semantics, as the expected results.

A row is (series, ts, seq, value); rows of a series are visited in (ts, seq) order.
"""


def two(x):
    return float(f"{x:.2f}") + 0.0


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def rates(rows, reset=1.0):
    state, out = {}, {}
    for s, ts, seq, v in in_order(rows):
        if v is None or ts is None:
            out[seq] = None
        elif s not in state:
            state[s], out[seq] = (ts, v), 0.0
        elif ts == state[s][0]:
            out[seq] = None
        else:
            d, dt = v - state[s][1], ts - state[s][0]
            out[seq] = reset if d < 0 else two(d / dt)
            state[s] = (ts, v)
    return out


def deltas(rows):
    state, out = {}, {}
    for s, ts, seq, v in in_order(rows):
        if v is None:
            out[seq] = None
        else:
            out[seq] = two(v - state[s]) if s in state else 0.0
            state[s] = v
    return out


def previous(rows):
    state, out = {}, {}
    for s, ts, seq, v in in_order(rows):
        out[seq] = state.get(s, 0.0)
        state[s] = v
    return out


def gated_rates(rows, reset=1.0):
    last, passed, out = {}, {}, {}
    for s, ts, seq, v in in_order(rows):
        grew = v > last.get(s, 0)
        last[s] = v
        if not grew:
            continue
        if s not in passed:
            out[seq], passed[s] = 0.0, (ts, v)
        elif ts == passed[s][0]:
            out[seq] = None
        else:
            d, dt = v - passed[s][1], ts - passed[s][0]
            out[seq] = reset if d < 0 else two(d / dt)
            passed[s] = (ts, v)
    return out


def shares(rows):
    """Value is (user, system, idle): share of user in the growth of the total."""
    total, part, out = {}, {}, {}
    for s, ts, seq, v in in_order(rows):
        t = float(sum(v))
        moved = two(t - total[s]) if s in total else 0.0
        total[s] = t
        if moved == 0:
            continue
        grown = two(v[0] - part[s]) if s in part else 0.0
        part[s] = v[0]
        out[seq] = grown / moved * 100 + 0.0
    return out
