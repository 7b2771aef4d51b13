"""Paths into edit documents, as expressions over VARIANT: read, sparse write, recursive merge with deletes, difference.

A path is a dotted text or a tuple of keys (for keys that hold a dot). Nothing here leaves the JVM. Objects are merged
and compared key by key through at most LEVELS nested objects; two that go deeper raise, nothing is cut. Arrays and
scalars are replaced as wholes. Keys come out in order, so equal documents have equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 6
_OBJECT = "map<string,variant>"
#: Types that a JSON number is read as.
NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"

Path = str | tuple[str, ...]


def keys(path: Path) -> tuple[str, ...]:
    return tuple(path.split(".")) if isinstance(path, str) else path


def parsed(text: Column) -> Column:
    """The document of a text; null where that is none."""
    return F.try_parse_json(text)


def _at(doc: Column, path: Path) -> Column:
    quoted = "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys(path))
    return F.try_variant_get(doc, f"${quoted}", "variant")


def number(doc: Column, path: Path) -> Column:
    """The finite number at a path; null where something else stands, or nothing."""
    found = _at(doc, path)
    value = F.try_variant_get(found, "$", "double")
    return F.when(F.schema_of_variant(found).rlike(NUMBER) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def text(doc: Column, path: Path) -> Column:
    """The text at a path; null where something else stands."""
    found = _at(doc, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def part(doc: Column, path: Path) -> Column:
    """What stands at a path."""
    return _at(doc, path)


def is_object(doc: Column) -> Column:
    return doc.try_cast(_OBJECT).isNotNull()


def nothing() -> Column:
    """JSON's null: as a value of a patch, what deletes."""
    return F.parse_json(F.lit("null"))


def written(values: dict[Path, Column]) -> Column:
    """A document of these values at their paths; null values, and objects of nothing else, are left out. Null where
    all are. A path that leads through another's value raises."""
    tree: dict = {}
    for path, value in values.items():
        node, (*above, last) = tree, keys(path)
        for k in above:
            node = node.setdefault(k, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} leads through a value")
        if last in node:
            raise ValueError(f"{path} is written twice, or leads to an object")
        node[last] = value.cast("variant")
    return _object(tree)


def _object(tree: dict) -> Column:
    entries = [x for k, v in tree.items() for x in (F.lit(k), _object(v) if isinstance(v, dict) else v)]
    held = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return F.transform(F.array(held), lambda m: F.when(F.size(m) > 0, F.to_variant_object(m)))[0]


def _deeper(levels: int) -> Column:
    return F.raise_error(f"objects are nested more than {levels} deep: raise `levels`").cast("variant")


def merged(base: Column, patch: Column, *, deletes: bool = True, levels: int = LEVELS) -> Column:
    """base with what patch says: its objects are merged key by key, all else replaces. deletes: JSON's null in a patch
    takes the key away, else it is a value. A null base counts as nothing, a null patch changes nothing."""

    def merge(x: Column, y: Column, left: int) -> Column:
        old, new = x.try_cast(_OBJECT), y.try_cast(_OBJECT)
        if not left:
            return F.when(new.isNotNull() & old.isNotNull(), _deeper(levels)).otherwise(y)
        gone = lambda v: F.is_variant_null(v) if deletes else F.lit(False)
        both = lambda m: F.map_zip_with(m, new, lambda _, a, b: F.when(b.isNull(), a).when(gone(b), F.lit(None).cast("variant")).otherwise(merge(a, b, left - 1)))
        empty = F.create_map().cast(_OBJECT)
        return F.when(new.isNotNull(), F.to_variant_object(F.map_filter(both(F.coalesce(old, empty)), lambda _, v: v.isNotNull()))).otherwise(y)

    # a patch may be a long expression: it is bound to a name, not repeated
    return F.transform(F.array(patch), lambda y: F.when(y.isNull(), base).otherwise(merge(base, y, levels)))[0]


def difference(base: Column, other: Column, *, levels: int = LEVELS) -> Column:
    """The least patch that makes other of base, `merged(base, difference(base, other)) = other`: deletes where base has
    a key that other lacks. Null where they are equal. As in any such patch, a key whose value in other is JSON's null
    counts as lacking."""

    def compare(x: Column, y: Column, left: int) -> Column:
        old, new = x.try_cast(_OBJECT), y.try_cast(_OBJECT)
        whole = F.when(F.coalesce(F.to_json(x) == F.to_json(y), F.lit(False)), F.lit(None).cast("variant")).otherwise(y)
        if not left:
            return F.when(old.isNotNull() & new.isNotNull() & whole.isNotNull(), _deeper(levels)).otherwise(whole)
        lacking = lambda v: v.isNull() | F.is_variant_null(v)
        each = F.map_zip_with(old, new, lambda _, a, b: F.when(lacking(b), F.when(~lacking(a), nothing())).when(lacking(a), b).otherwise(compare(a, b, left - 1)))
        held = F.map_filter(each, lambda _, v: v.isNotNull())
        return F.when(old.isNotNull() & new.isNotNull(), F.when(F.size(held) > 0, F.to_variant_object(held))).otherwise(whole)

    return compare(base, other, levels)


def leaves(doc: Column, *, levels: int = LEVELS) -> Column:
    """(path, value as JSON) of everything that is not an object with keys, in order of paths; keys joined by dots."""
    kind = "array<struct<path:string,value:string>>"

    def walk(x: Column, path: Column, left: int) -> Column:
        inside = x.try_cast(_OBJECT)
        one = F.array(F.struct(path.alias("path"), F.to_json(x).alias("value"))).cast(kind)
        if not left:
            return F.when(F.size(inside) > 0, F.raise_error(f"objects are nested more than {levels} deep: raise `levels`").cast(kind)).otherwise(one)
        each = F.transform(F.array_sort(F.map_keys(inside)), lambda k: walk(inside[k], F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)), left - 1))
        return F.when(F.size(inside) > 0, F.flatten(each)).otherwise(one)

    return F.when(doc.isNotNull(), walk(doc, F.lit(""), levels))
