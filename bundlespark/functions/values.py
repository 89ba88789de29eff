"""Reading semi-structured frontmatter: columns over VARIANT.

Readers are type-strict where a projection asks for text, and loose where a filter
compares scalars. A missing key is SQL NULL; a JSON null is present.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode's white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _path(*keys: str) -> str:
    quoted = (f"['{k}']" if "'" not in k else f'["{k}"]' for k in keys)
    return "$" + "".join(quoted)


def get(v: Column, *keys: str) -> Column:
    """The value under ``keys`` as VARIANT; NULL if any is missing or a parent is no object."""
    return F.try_variant_get(v, _path(*keys), "variant")


def let(x: Column, body) -> Column:
    """``body`` of ``x``, which is evaluated once however often ``body`` names it.

    A fold over nothing that begins with ``x`` and is finished by ``body``. The first element of a
    transformed array would do as well, but for each row Spark works the type of such an element
    out again, whether it may be null included, from all that ``body`` holds.
    """
    return F.aggregate(F.expr("cast(array() as array<int>)"), x, lambda acc, _: acc, body)


def kind_of(v: Column, items: Column) -> Column:
    """``kind`` of a column that is worked out already, with its elements or whatever else is there only for a list."""
    # The schema of a list or object is worked out from all that it holds, so those are told apart by casts.
    scalars = F.create_map(*map(F.lit, ("STRING", "string", "BOOLEAN", "boolean", "VOID", "null")))
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(items.isNotNull(), "array")
            .when(F.try_variant_get(v, "$", "struct<>").isNotNull(), "object").otherwise(F.coalesce(F.try_element_at(scalars, F.schema_of_variant(v)), F.lit("number"))))


def kind(v: Column) -> Column:
    """One of string, number, boolean, null, array, object; NULL for a missing value."""
    return let(v, lambda w: kind_of(w, F.try_variant_get(w, "$", "array<struct<>>")))


def read(v: Column) -> Column:
    """struct<v, k, t, xs>: a value, its kind, its text if it is one and its elements if it is a list, each read once."""
    typed = let(v, lambda w: let(F.struct(w.alias("v"), items(w).alias("xs")), lambda p: F.struct(p["v"].alias("v"), kind_of(p["v"], p["xs"]).alias("k"), p["xs"].alias("xs"))))
    return let(typed, lambda q: F.struct(q["v"].alias("v"), q["k"].alias("k"), text_of(q["v"], q["k"]).alias("t"), q["xs"].alias("xs")))


def text_of(v: Column, k: Column) -> Column:
    """The text that ``v`` is, which has the kind ``k``; both worked out already."""
    return F.when(k == "string", F.try_variant_get(v, "$", "string"))


def _if_schema(v: Column, wanted: str, as_type: str) -> Column:
    return let(v, lambda w: F.when(F.schema_of_variant(w) == wanted, F.try_variant_get(w, "$", as_type)))


def text(v: Column) -> Column:
    """The string that ``v`` is; NULL for anything else, numbers included."""
    return _if_schema(v, "STRING", "string")


def boolean(v: Column) -> Column:
    return _if_schema(v, "BOOLEAN", "boolean")


def integer(v: Column) -> Column:
    """The number that ``v`` is if it is whole; NULL for text, fractions, anything over 38 digits."""
    def whole(w):
        exact = let(F.try_variant_get(w, "$", "double"), lambda d: d == d.cast("decimal(38,0)").cast("double"))
        is_whole = let(F.schema_of_variant(w), lambda s: F.when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), True).otherwise(exact))
        return F.when(kind(w) == "number", F.when(is_whole, F.try_variant_get(w, "$", "decimal(38,0)")))

    return let(v, whole)


def scalar_text(v: Column) -> Column:
    """What a filter compares: text as it is, numbers and booleans as JSON; NULL for null, lists and objects."""
    return let(v, lambda w: let(kind(w), lambda k: F.when(k == "string", F.try_variant_get(w, "$", "string")).when(k.isin("number", "boolean"), F.to_json(w))))


def items(v: Column) -> Column:
    """The elements of a list; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def one_or_many(v: Column) -> Column:
    """A list's elements, or the one value; empty if missing."""
    return let(v, lambda w: F.when(w.isNull(), F.expr("cast(array() as array<variant>)")).otherwise(F.coalesce(items(w), F.array(w))))


def texts(v: Column) -> Column:
    """The strings of a list, others dropped; a bare string is a list of one."""
    some = lambda xs: F.filter(F.transform(xs, text), lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    return let(read(v), lambda r: F.when(r["k"] == "array", some(r["xs"])).when(r["k"] == "string", F.array(r["t"])).otherwise(none))


def field_values(fm: Column, path: tuple[str, ...]) -> Column:
    """All values that a selector of one or two keys reaches, lists opened: array<variant>."""
    if len(path) == 1:
        return one_or_many(get(fm, path[0]))
    reached = F.transform(one_or_many(get(fm, path[0])), lambda x: get(x, path[1]))
    return F.flatten(F.transform(F.filter(reached, lambda x: x.isNotNull()), one_or_many))


def keys(fm: Column) -> Column:
    """The top-level keys, sorted."""
    return F.array_sort(F.coalesce(F.map_keys(fm.cast("map<string,variant>")), F.expr("cast(array() as array<string>)")))


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(x, F.lit(_WHITE))


def is_blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def repeated(keyed: Column) -> Column:
    """The runs of two or more equal keys of array<struct<k, i, ...>>, each an array by place, in the order of their first places.

    Elements are sorted together once; a run ends where the next begins, so the work after
    the sort is in proportion to the list.
    """
    def runs(ys):
        before = lambda j: F.get(ys, j - 1)["k"]
        starts = F.filter(F.transform(ys, lambda y, j: F.when((j == 0) | (before(j) != y["k"]), j)), lambda j: j.isNotNull())

        def cut(ss):
            long = F.filter(F.transform(ss, lambda s, t: F.struct(s.alias("at"), (F.coalesce(F.get(ss, t + 1), F.size(ys)) - s).alias("n"))), lambda x: x["n"] > 1)
            return F.sort_array(F.transform(long, lambda x: let(F.slice(ys, x["at"] + 1, x["n"]), lambda run: F.struct(run[0]["i"].alias("i"), run.alias("run")))))

        return F.transform(let(starts, cut), lambda x: x["run"])

    return let(F.sort_array(keyed), runs)  # sort_array: array_sort's default comparison is interpreted


def key_of(r: Column) -> Column:
    """``canonical`` of a value as ``read`` gives it."""
    number = F.try_variant_get(r["v"], "$", "double").cast("string")
    return F.concat(r["k"], F.lit(":"), F.when(r["k"] == "string", r["t"]).when(r["k"] == "number", number).otherwise(F.to_json(r["v"])))


def canonical(v: Column) -> Column:
    """A string equal for equal scalars of one kind; numbers compare by value."""
    number = lambda w: F.try_variant_get(w, "$", "double").cast("string")
    return let(v, lambda w: let(kind(w), lambda k: F.concat(k, F.lit(":"), F.when(k == "number", number(w)).otherwise(F.to_json(w)))))
