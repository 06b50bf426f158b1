"""Repeating groups and redefined bytes as relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decoders
from ..functions.decoders import Reading
from ..layout import Item, Layout


def _leaves(item: Item) -> list[Item]:
    return [i for i in item.walk() if i.elementary and not i.filler]


def _occurrence(owner: Item, leaf: Item, n: int):
    """Bytes of a leaf in the owner's n-th occurrence."""
    one = leaf.size() if leaf is owner else leaf.total()
    return F.substring("rec", leaf.offset + n * owner.size() + 1, one)


def child_rows(records: DataFrame, owner: Item, reading: Reading = Reading(), keep: tuple[str, ...] = ("rec_no",), counted: Item | None = None) -> DataFrame:
    """A row for each occurrence of a repeating item: ``keep``, occurrence (from 1), its fields. ``counted`` names the DEPENDING ON field to honour."""
    one = [F.struct(*(decoders.value(leaf, reading, _occurrence(owner, leaf, n)).alias(leaf.name) for leaf in _leaves(owner))) for n in range(owner.occurs)]
    rows = F.array(*one)
    if counted is not None:
        rows = F.slice(rows, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(owner.occurs), F.coalesce(decoders.value(counted, reading).cast("int"), F.lit(0)))))
    return records.select(*keep, F.posexplode(rows).alias("at", "item")).select(*keep, (F.col("at") + 1).alias("occurrence"), "item.*")


def flattened(records: DataFrame, owner: Item, reading: Reading = Reading(), keep: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """name_1 .. name_n for each field of a repeating item."""
    return records.select(*keep, *(decoders.value(leaf, reading, _occurrence(owner, leaf, n)).alias(f"{leaf.name}_{n + 1}") for leaf in _leaves(owner) for n in range(owner.occurs)))


def branches(records: DataFrame, layout: Layout, discriminator: str, mapping: dict[str, str], reading: Reading = Reading(), keep: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """One nullable struct for each branch of redefined bytes, set where the discriminator has its value."""
    code = decoders.strip(decoders.value(layout.find(discriminator), reading).cast("string"))
    out = []
    for branch in dict.fromkeys(mapping.values()):
        item = layout.find(branch)
        mine = [v for v, b in mapping.items() if b == branch]
        out.append(F.when(code.isin(mine), F.struct(*(decoders.value(leaf, reading).alias(leaf.name) for leaf in _leaves(item)))).alias(branch))
    return records.select(*keep, *out)
