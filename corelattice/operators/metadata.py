"""Attaching metadata, and trees of subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelattice.operators.current import is_missing_text


def attach(df: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """Left join of sample metadata; a column that ``df`` already has is not taken.

    Rows of ``meta`` equal in every column are one; a key with several different
    rows fans out, as a left join does.
    """
    new = [c for c in meta.columns if c == on or c not in df.columns]
    return df.join(meta.select(*new).distinct(), on, "left")


def inherit(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """The parent's rows with the columns that only the child has; NULL outside the child."""
    new = [c for c in child.columns if c not in parent.columns]
    return parent.join(child.select(key, *new), key, "left")


def absorb(parent: DataFrame, child: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The parent's rows, ``columns`` overwritten where the child has a value that isn't missing.

    NULL, blank and ``nan`` are missing.
    """
    out = parent.join(child.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    for c in columns:
        new = F.when(~is_missing_text(F.col(f"__{c}")), F.col(f"__{c}"))
        out = out.withColumn(c, F.coalesce(new, F.col(c))).drop(f"__{c}")
    return out


def restore(root: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``root`` whose key is in ``subset``, with all features of the root."""
    return root.join(subset.select(key), key, "left_semi")


def walk(nodes: DataFrame, start: str) -> DataFrame:
    """``node``, ``parent``, ``depth``, ``path``, ``terminal`` of a node and all its descendants.

    ``nodes`` has ``node`` and ``parent`` (NULL at the root) and must be a tree.
    """
    return nodes.sparkSession.sql(
        """
        WITH RECURSIVE t(node, parent, depth, path) AS (
          SELECT node, parent, 0, node FROM {nodes} WHERE node = :start
          UNION ALL
          SELECT n.node, n.parent, t.depth + 1, concat(t.path, '/', n.node) FROM {nodes} n JOIN t ON n.parent = t.node)
        SELECT t.node, t.parent, t.depth, t.path, p.parent IS NULL AS terminal
        FROM t LEFT JOIN (SELECT DISTINCT parent FROM {nodes}) p ON t.node = p.parent
        """,
        args={"start": start}, nodes=nodes,
    )


def absorb_upwards(tables: dict[str, DataFrame], parents: dict[str, str | None], node: str, key: str, columns: list[str]) -> dict[str, DataFrame]:
    """``tables`` with ``columns`` of ``node`` absorbed by every node above it, up to the root.

    Each ancestor takes the values of the node itself, as the nodes between hold
    no more of its rows.  A column that an ancestor lacks is added.  A cycle or a
    node without a table raises.
    """
    out, at, seen = dict(tables), parents.get(node), {node}
    while at is not None:
        if at in seen:
            raise ValueError(f"{at} is above itself")
        seen.add(at)
        up = out[at]
        for c in columns:
            if c not in up.columns:
                up = up.withColumn(c, F.lit(None).cast(tables[node].schema[c].dataType))
        out[at] = absorb(up, tables[node], key, columns)
        at = parents.get(at)
    return out


def subset_node(parent: str, column: str, values: list[str]) -> str:
    """Name of the node that a sub-clustering makes."""
    return f"{parent}_subset_{column}_" + "_".join(values)
