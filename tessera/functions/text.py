"""Exact text formats that no built-in function gives."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(x: float) -> str:
    """Nine significant digits in the shortest form; what is no number becomes 0."""
    return "0" if x != x else f"{x:.9G}"


def vertex_lines(v: list[float] | None) -> str | None:
    return None if v is None else "".join(f"v {number(-v[i])} {number(v[i + 1])} {number(v[i + 2])}\n" for i in range(0, len(v) - 2, 3))


def obj_vertices(values: str | Column) -> Column:
    """``v x y z`` lines of a flat array of coordinates; x is negated (the other hand)."""

    def lines(column: pd.Series) -> pd.Series:
        return column.map(vertex_lines)

    return F.pandas_udf(lines, T.StringType())(values)


def _vectors(tag: str, values: list[float] | None, dim: float, signs: tuple[int, ...]) -> list[str]:
    if values is None:
        return []
    step = int(dim)
    return [tag + "".join(f" {number(sign * x)}" for sign, x in zip(signs, values[at : at + step], strict=False)) + "\n" for at in range(0, len(values), step)]


def obj_lines(name: str, vertices: str, uv: str, normals: str, faces: str) -> Column:
    """OBJ text of columns ``struct<dim, values>``; ``faces`` holds index triples for each submesh."""

    def text(names: pd.Series, v: pd.Series, v_dim: pd.Series, t: pd.Series, t_dim: pd.Series, n: pd.Series, n_dim: pd.Series, f: pd.Series) -> pd.Series:
        out = []
        for k, called in enumerate(names):
            lines = [f"g {called}\n", *_vectors("v", v[k], v_dim[k], (-1, 1, 1)), *_vectors("vt", t[k], t_dim[k], (1, 1)), *_vectors("vn", n[k], n_dim[k], (-1, 1, 1))]
            for at, triples in enumerate([] if f[k] is None else f[k]):
                lines.append(f"g {called}_{at}\n")
                lines += ["f " + " ".join(f"{i + 1}/{i + 1}/{i + 1}" for i in reversed(corners)) + "\n" for corners in ([] if triples is None else triples)]
            out.append("".join(lines))
        return pd.Series(out)

    parts = [F.col(f"{c}.{p}") for c in (vertices, uv, normals) for p in ("values", "dim")]
    return F.pandas_udf(text, T.StringType())(F.col(name), *parts, F.col(faces))
