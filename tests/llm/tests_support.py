from collections import defaultdict

from test_near import shingles


def brute_components(rows, k, num, den):
    """Smallest id that links reach, by counting common shingles of every pair that has one."""
    sets, holders = {i: shingles(t, k) for i, t in rows}, defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        both = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                both[j] += 1
            holders[s].append(i)
        for j, n in both.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}
