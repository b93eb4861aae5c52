"""Plain forms of the definitions that several tests hold results against."""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    """Equal texts, or word sequences of an edit similarity of at least 0.8."""
    x, y = (a or "").split(), (b or "").split()
    if (a or "") == (b or ""):
        return True
    longer = max(len(x), len(y))
    return bool(x and y) and abs(len(x) - len(y)) <= 0.2 * longer + 1e-9 and distance(x, y) <= 0.2 * longer + 1e-9


def brute_lines(rows, short_repeats=False):
    """Places (id, number) of lines that go: an earlier line is at most one word away, or equal."""
    lines = [(i, n, line, line.split(" ")) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    gone, seen, long = set(), set(), []
    for i, n, line, words in lines:
        big = len(words) >= 5
        if line and (big or short_repeats):
            if line in seen or big and any(abs(len(words) - len(w)) <= 1 and distance(words, w) <= 1 for w in long):
                gone.add((i, n))
        if big:
            long.append(words)
        if line:
            seen.add(line)
    return gone
