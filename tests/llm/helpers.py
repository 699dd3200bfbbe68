"""Small helpers of the operator tests."""


def rows(df):
    return [tuple(r) for r in df.collect()]


def union_find(n, pairs):
    """The smallest index of each index's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
