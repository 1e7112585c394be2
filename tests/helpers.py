"""Small inline stores."""

from signalvault.model import ATTRS, GROUPS, NODES, Store, conform, with_ancestors

NODE_COLUMNS = "shot string, tree string, signal string, node string, seg int, " + NODES.split("seg int, ")[1]


def node(shot, tree, signal, name, value, kind=None, shape=None, seg=0):
    """A leaf from a Python value; the kind follows from it unless given."""
    scalar = not isinstance(value, list)
    values = [value] if scalar else value
    first = values[0] if values else 0.0
    kind = kind or ("bin" if isinstance(first, (bytes, bytearray)) else "str" if isinstance(first, str)
                    else "bool" if isinstance(first, bool) else "i64" if isinstance(first, int) else "f64")
    shape = ([] if scalar else [len(values)]) if shape is None else shape
    row = dict(shot=shot, tree=tree, signal=signal, node=name, seg=seg, kind=kind, shape=shape,
               f64=None, f32=None, i64=None, str=None, bin=None)
    column = "i64" if kind == "bool" else kind
    if kind == "bin":
        row["bin"] = bytearray(first)
    elif kind in ("f64", "f32"):
        row[column] = [float(v) for v in values]
    elif kind in ("i64", "bool"):
        row[column] = [int(v) for v in values]
    else:
        row[column] = values
    return row


def attr(shot, tree, signal, name, value, on=None):
    array = isinstance(value, list)
    values = value if array else [value]
    row = dict(shot=shot, tree=tree, signal=signal, node=on, name=name, kind=None, is_array=array,
               f64=None, i64=None, str=None, bin=None)
    first = values[0]
    if isinstance(first, bytes):
        row.update(kind="bin", bin=bytearray(first))
    elif isinstance(first, str):
        row.update(kind="str", str=values)
    elif isinstance(first, int):
        row.update(kind="i64", i64=values)
    else:
        row.update(kind="f64", f64=values)
    return row


def store(spark, nodes=(), attrs=(), extra_groups=()):
    n = conform(spark.createDataFrame(list(nodes), NODE_COLUMNS), NODES)
    a = spark.createDataFrame(list(attrs), ATTRS)
    g = with_ancestors(n)
    if extra_groups:
        rows = []
        for path in extra_groups:
            parts = path.split("/")
            for depth, level in enumerate(("shot", "tree", "signal")[:len(parts)], start=1):
                rows.append(tuple((parts[:depth] + [None] * 3)[:3]) + (level,))
        g = g.unionByName(spark.createDataFrame(rows, GROUPS)).distinct()
    return Store(n, g, a)


def keys_of(s):
    return {tuple(r) for r in s.signal_keys().collect()}
