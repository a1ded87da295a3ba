"""Vector columns (arrays of one number type) and matrices (struct of rows, cols, data by rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import arrays

Fn = Callable[..., Column]
_col = arrays._col

length = arrays.size
get = arrays.get
set_ = arrays.update
slice_ = arrays.slice_
concat = arrays.concat
map_ = arrays.map_
fold = arrays.fold


def from_array(a: Column, kind: str = "double") -> Column:
    return a.cast(f"array<{kind}>")


def to_array(v: Column) -> Column:
    return v


def fill(n, value) -> Column:
    return F.array_repeat(_col(value), F.greatest(_col(n), F.lit(0)).cast("int"))


def zeros(n) -> Column:
    return fill(n, 0.0)


def ones(n) -> Column:
    return fill(n, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def matrix(rows, cols, data: Column) -> Column:
    return F.struct(_col(rows).cast("long").alias("rows"), _col(cols).cast("long").alias("cols"), data.alias("data"))


def vector_to_matrix(v: Column, rows, cols) -> Column:
    """The vector by rows; other than rows * cols numbers is an error."""
    fits = F.size(v) == _col(rows) * _col(cols)
    return matrix(rows, cols, F.when(fits, v).otherwise(F.array(F.raise_error(F.lit("matrix has another number of cells")).cast("double"))))


def matrix_rows(m: Column) -> Column:
    return m["rows"]


def matrix_cols(m: Column) -> Column:
    return m["cols"]


def matrix_get(m: Column, r, c) -> Column:
    r, c = _col(r), _col(c)
    inside = (r >= 0) & (r < m["rows"]) & (c >= 0) & (c < m["cols"])
    return F.when(inside, F.get(m["data"], (r * m["cols"] + c).cast("int"))).otherwise(F.raise_error(F.lit("matrix index out of range")).cast("double"))


def matrix_set(m: Column, r, c, value) -> Column:
    """A copy with one cell replaced; an index outside is an error."""
    r, c = _col(r), _col(c)
    inside = (r >= 0) & (r < m["rows"]) & (c >= 0) & (c < m["cols"])
    at = F.when(inside, r * m["cols"] + c).otherwise(F.raise_error(F.lit("matrix index out of range")).cast("long"))
    return matrix(m["rows"], m["cols"], F.transform(m["data"], lambda x, i: F.when(i == at, _col(value)).otherwise(x)))


def _count(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def matrix_get_row(m: Column, r) -> Column:
    return F.slice(m["data"], (_col(r) * m["cols"] + 1).cast("int"), m["cols"].cast("int"))


def matrix_get_col(m: Column, c) -> Column:
    return F.transform(_count(m["rows"]), lambda r: F.get(m["data"], (r * m["cols"] + _col(c)).cast("int")))


def matrix_to_vector(m: Column) -> Column:
    return m["data"]


def matrix_from_array(a: Column) -> Column:
    """A matrix of an array of rows; rows of different lengths are an error, no rows give 0 x 0."""
    cols = F.coalesce(F.size(F.get(a, F.lit(0))), F.lit(0))
    data = F.when(F.forall(a, lambda r: F.size(r) == cols), F.flatten(a)).otherwise(F.array(F.raise_error(F.lit("rows of different lengths")).cast("double")))
    return matrix(F.size(a), cols, data)


matrix_from_rows = matrix_from_array


def matrix_to_array(m: Column) -> Column:
    return F.transform(_count(m["rows"]), lambda r: F.slice(m["data"], (r * m["cols"] + 1).cast("int"), m["cols"].cast("int")))


matrix_to_rows = matrix_to_array


def matrix_transpose(m: Column) -> Column:
    cells = F.flatten(F.transform(_count(m["cols"]), lambda c: F.transform(_count(m["rows"]), lambda r: F.get(m["data"], (r * m["cols"] + c).cast("int")))))
    return matrix(m["cols"], m["rows"], cells)


def matrix_fill(rows, cols, value) -> Column:
    return matrix(rows, cols, fill(_col(rows) * _col(cols), value))


def matrix_zeros(rows, cols) -> Column:
    return matrix_fill(rows, cols, 0.0)


def matrix_ones(rows, cols) -> Column:
    return matrix_fill(rows, cols, 1.0)


def matrix_map_elements(m: Column, f: Fn) -> Column:
    """f(x, row, column) of each cell."""
    at = lambda i: (F.floor(i / m["cols"]).cast("long"), i % m["cols"])
    return matrix(m["rows"], m["cols"], F.transform(m["data"], lambda x, i: f(x, *at(i))))


def matrix_map_rows(m: Column, f: Fn) -> Column:
    """f(row, number) of each row, stacked."""
    return matrix_from_array(F.transform(matrix_to_array(m), lambda row, r: f(row, r)))
