"""Sums of element vectors by entity (atoms or bonds of a molecule, lines of an order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ATOM_FEATURES, BOND_FEATURES, BONDS, CHIRAL, COVALENT_SCALE, COVALENT_SHIFT, HYBRIDS, MASS_SCALE, MASS_SHIFT, RADII, STEREO, SYMBOLS, VDW_SCALE, VDW_SHIFT


#: An entity is a giant from this many rows and this part of all rows on; there are at most PART giants.
GIANT, PART = 100_000, 1000


def giants(df: DataFrame, entity: str) -> list:
    """Entities so large that their rows shouldn't meet in one task: frequent items of one pass, which shuffles nothing."""
    found = df.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{entity}`, {PART}, {8 * PART})").alias("top")).first()
    return [r.item for r in found.top or [] if r["count"] >= GIANT and r["count"] * PART >= found.n and r.item is not None]


def entity_sums(df: DataFrame, entity: str, index: str, made: dict[str, Column], drop_last: bool = False, whole: dict[str, Column] | None = None) -> DataFrame:
    """A row for each entity; drop_last leaves out the rows with its highest index (an entity of one row then sums to 0). ``whole``:
    further sums beside these, over all rows, from the same pass.

    Without the last, an entity's rows meet in one shuffle by entity. A giant's don't: its sums by (entity, index) come
    first and the last index's are taken off, so sums of fractions may differ from direct ones in their last digits.
    """
    whole = whole or {}
    if not drop_last:
        return df.groupBy(entity).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (made | whole).items()))
    some = df.select(entity, index, *(c.alias(k) for k, c in (made | whole).items()))
    large = giants(df, entity)
    is_large = F.coalesce(F.col(entity).isin(large), F.lit(False)) if large else F.lit(False)
    kept = F.col(index) < F.max(index).over(Window.partitionBy(entity))  # no row of an entity without any index
    met = some.where(~is_large).withColumn("_kept", kept).groupBy(entity)
    out = met.agg(*(F.coalesce(F.sum(F.when(F.col("_kept"), F.col(k))), F.lit(0)).alias(k) for k in made), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in whole))
    if not large:
        return out
    own = some.where(is_large).groupBy(entity, index).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*made, *whole)))
    last = F.max(F.struct(F.col(index), *made)).alias("_last")  # nulls sort below every index
    own = own.groupBy(entity).agg(last, *(F.sum(k).alias(k) for k in (*made, *whole)))
    none = F.col(f"_last.{index}").isNull()
    return out.unionByName(own.select(entity, *(F.when(none, F.col(k) - F.col(k)).otherwise(F.col(k) - F.col(f"_last.{k}")).alias(k) for k in made), *whole))


def joined_features(atoms: DataFrame, bonds: DataFrame, entity: str) -> DataFrame:
    """Both sides' sums side by side; an entity that one side lacks has zeros there."""
    own = [c for c in [*atoms.columns, *bonds.columns] if c != entity]
    return atoms.join(bonds, entity, "full").select(entity, *(F.coalesce(c, F.lit(0)).alias(c) for c in own))


def _hot(value: str, names: list[str], permitted: list[str], item) -> list[Column]:
    own = F.when(item[value].isin(*permitted), item[value]).otherwise(F.lit(permitted[-1]))
    return [(own == p).cast("double") for p, _ in zip(permitted, names, strict=True)]


def radii(symbol: Column) -> list[Column]:
    """The scaled van der Waals and covalent radius of an element; null for one without an entry. Not among the 68 features."""
    table = F.create_map(*(F.lit(x) for s, (vdw, covalent) in RADII.items() for x in (s, F.array(F.lit(vdw), F.lit(covalent)))))
    found = F.try_element_at(table, symbol)
    return [((found[0] - F.lit(VDW_SHIFT)) / F.lit(VDW_SCALE)).alias("vdw_scaled"), ((found[1] - F.lit(COVALENT_SHIFT)) / F.lit(COVALENT_SCALE)).alias("covalent_scaled")]


def featurize(parsed: DataFrame, drop_last_atom: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mol_id, error, the columns to keep, 68 features) from parsed molecules, row by row without a shuffle.

    Atom features are summed over all atoms but the last (as the models were trained), bond features over all
    bonds. Unlisted symbols count as Unknown, other bond kinds as aromatic, other stereo marks as none.
    Molecules without such atoms or bonds have zeros; so has one that can't be read, which keeps its error.
    """
    taken = F.slice("atoms", F.lit(1), F.greatest(F.size("atoms") - (1 if drop_last_atom else 0), F.lit(0)))

    def sums(items: Column, vector, names: list[str]) -> Column:
        return F.aggregate(items, F.array(*[F.lit(0.0)] * len(names)), lambda a, x: F.zip_with(a, F.array(*vector(x)), lambda p, q: p + q))

    def atom(x: Column) -> list[Column]:
        return [*_hot("symbol", SYMBOLS, SYMBOLS, x), *_hot("hybridization", HYBRIDS, HYBRIDS, x), x["in_ring"].cast("double"), x["aromatic"].cast("double"), (x["mass"] - F.lit(MASS_SHIFT)) / F.lit(MASS_SCALE), *_hot("chirality", CHIRAL, CHIRAL, x)]

    def bond(x: Column) -> list[Column]:
        return [*_hot("kind", BONDS, BONDS, x), x["conjugated"].cast("double"), x["in_ring"].cast("double"), *_hot("stereo", STEREO, STEREO, x)]

    both = parsed.select("mol_id", "error", *keep, sums(taken, atom, ATOM_FEATURES).alias("a"), sums(F.col("bonds"), bond, BOND_FEATURES).alias("b"))
    return both.select("mol_id", "error", *keep, *(F.get("a", F.lit(i)).alias(n) for i, n in enumerate(ATOM_FEATURES)), *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(BOND_FEATURES)))
