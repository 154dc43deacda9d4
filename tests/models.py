"""Plain models of what the operators compute."""

from itertools import combinations

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


def canon(s):
    return min(s, rc(s))


def encode(s):
    out = 0
    for c in s:
        out = out * 4 + "ACGT".index(c)
    return out


def decode(x, k):
    return "".join("ACGT"[(x >> (2 * (k - 1 - i))) & 3] for i in range(k))


def kmers(s, k):
    return [canon(s[i : i + k]) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def neighbours(x):
    every = {canon(x[1:] + c) for c in "ACGT"} | {canon(c + x[:-1]) for c in "ACGT"}
    return every - {x}


def components(vertices):
    left, out = set(vertices), []
    while left:
        stack, own = [left.pop()], set()
        while stack:
            x = stack.pop()
            own.add(x)
            for y in neighbours(x) & left:
                left.discard(y)
                stack.append(y)
        out.append(own)
    return out


def cut(counts, least, most):
    """(threshold, size, weight, smallest) of the components, cutting larger ones."""
    out, now, t = [], [dict(counts)], 1
    while now:
        later = []
        for part in now:
            for own in components(part):
                if len(own) < least:
                    continue
                if len(own) <= most:
                    out.append((t, len(own), sum(part[x] for x in own), min(own)))
                else:
                    later.append({x: part[x] for x in own if part[x] > t})
        now, t = later, t + 1
    return sorted(out)


def unitigs(counts):
    """(sequence up to strand, mean, least, most) of maximal unbranched paths, no cycles."""
    have = set(counts)

    def after(x):
        return [x[1:] + c for c in "ACGT" if canon(x[1:] + c) in have]

    def step(x):
        ahead = after(x)
        if len(ahead) != 1 or len(after(rc(ahead[0]))) != 1:
            return None
        return ahead[0]

    out = set()
    for v in have:
        for x in (v, rc(v)):
            if step(rc(x)) is not None:
                continue
            path, seen = [x], {x}
            while (y := step(path[-1])) is not None and y not in seen:
                path.append(y)
                seen.add(y)
            seq = path[0] + "".join(p[-1] for p in path[1:])
            f = [counts[canon(p)] for p in path]
            out.add((min(seq, rc(seq)), sum(f) // len(f), min(f), max(f)))
    return out


def linkage(d):
    """Naive average linkage over all pairs of members: (height, members) of each merge."""
    groups, out = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        best = None
        for i, j in combinations(range(len(groups)), 2):
            h = sum(d[a][b] for a in groups[i] for b in groups[j]) / len(groups[i]) / len(groups[j])
            if best is None or h < best[0] - 1e-12:
                best = (h, i, j)
        h, i, j = best
        groups[i] = groups[i] + groups.pop(j)
        out.append((round(h, 9), list(groups[i])))
    return out, groups[0] if groups else []
