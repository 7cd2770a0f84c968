"""Hamming-distance self-joins over fingerprints held as BIGINT words.

Three candidate generators, all by equal keys (never a cross join):

* ``band_pairs`` -- exact. The bits are cut into ``m`` disjoint bands; two
  fingerprints within distance ``t`` differ in at most ``r = t div m`` bits of some
  band (pigeonhole). Each row is indexed under its exact band values and probes
  with every value within ``r`` bits of its own; the join key is (band, value).
  ``r = 0`` with ``m = t + 1`` is the classic pigeonhole split; the planner picks
  ``m`` by an estimated cost (multi-index hashing, Norouzi et al. 2012). Radii may
  also differ from band to band (``operators.pigeonhole``).
* ``lsh_pairs`` -- approximate bit-sampling LSH with seeded positions.
* Equal fingerprints are collapsed first (``collapse``), so a fingerprint shared
  by a third of all rows becomes one representative plus a member list and never
  produces pairs among its copies.

A pair that meets in several bands/tables is emitted only in the first one where
it meets (a predicate, so no ``distinct`` shuffle). The distance check runs where
they meet (``operators.buckets``, or the join condition of LSH), so unverified candidates are never materialised.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F, types as T

from neardup import constants as C
from neardup.functions.scalars import pack_bits
from neardup.operators.buckets import TILE, near_links, near_pairs
from neardup.session import cut_lineage


def word_names(prefix: str, n_words: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n_words)]


def with_words(df: DataFrame, fp_col: str, n_words: int, prefix: str = "w") -> DataFrame:
    return df.select("*", *[F.col(fp_col)[i].alias(f"{prefix}{i}") for i in range(n_words)])


def _word_masks(start: int, end: int, n_words: int) -> list[int]:
    """Per word, the signed 64-bit mask of global bits [start, end) (bit 0 = MSB of word 0)."""
    out = []
    for k in range(n_words):
        m = 0
        for p in range(max(start, 64 * k), min(end, 64 * k + 64)):
            m |= 1 << (63 - (p - 64 * k))
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def masked_distance(a_words: list[str], b_words: list[str], masks: list[int]) -> Column:
    terms = [F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(m)))
             for a, b, m in zip(a_words, b_words, masks) if m != 0]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def distance(a_words: list[str], b_words: list[str]) -> Column:
    terms = [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(a_words, b_words)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def extract_bits(word_cols: list[str], start: int, end: int) -> Column:
    """Global bits [start, end) as a BIGINT (first bit most significant); end - start <= 63."""
    out = None
    for k, w in enumerate(word_cols):
        a, b = max(start, 64 * k), min(end, 64 * k + 64)
        if a >= b:
            continue
        la, lb = a - 64 * k, b - 64 * k
        piece = F.shiftrightunsigned(F.col(w), 64 - lb).bitwiseAND(F.lit((1 << (lb - la)) - 1))
        out = piece if out is None else F.shiftleft(out, lb - la).bitwiseOR(piece)
    return out


# ---------------------------------------------------------------------------
# collapse equal fingerprints
# ---------------------------------------------------------------------------

def collapse(candidates: DataFrame, id_col: str = "id", fp_col: str = "fp") -> tuple[DataFrame, DataFrame]:
    """(reps(rep, fp), copies(id, rep)): one representative (smallest id) per fingerprint.

    ``copies`` lists the rows whose fingerprint equals a smaller id's; they join
    their representative's component at distance 0, which every threshold admits.
    """
    c = candidates.where(F.col(fp_col).isNotNull()).select(id_col, fp_col)
    # written, so that AQE can split a hot fingerprint's copies in the join below
    reps = cut_lineage(c.groupBy(fp_col).agg(F.min(id_col).alias("rep")))
    copies = (c.join(reps, fp_col).where(F.col(id_col) != F.col("rep"))
              .select(F.col(id_col).alias("id"), "rep"))
    return reps.select("rep", fp_col), copies


# ---------------------------------------------------------------------------
# exact band join
# ---------------------------------------------------------------------------

#: Own rows (of a table large enough for as many tasks, four times as many) and guests of a bucket that one task compares; fuller
#: buckets are cut into tiles.
OWN_ROWS, GUEST_ROWS = 16_384, 65_536
#: Blocks that a whole table is cut into at least, before tiles grow.
BLOCKS = 12
VARIANTS_INLINE = 64   # up to this many probe variants per band are inlined as expressions


def masks_within(width: int, radius: int) -> list[int]:
    out = []
    for r in range(radius + 1):
        for pos in combinations(range(width), r):
            m = 0
            for p in pos:
                m |= 1 << p
            out.append(m)
    return out


@dataclass(frozen=True)
class BandPlan:
    bits: int
    threshold: int
    bands: tuple          # ((start, end), ...)
    radius: int
    probes_per_row: int
    est_candidates: float
    radii: tuple = ()     # a radius for each band (-1: not used); empty: ``radius`` in all

    @property
    def allowed(self) -> tuple:
        return self.radii or (self.radius,) * len(self.bands)

    @property
    def est_rows(self) -> float:
        return self.probes_per_row + self.est_candidates


def layout(bits: int, m: int) -> tuple:
    base, extra = divmod(bits, m)
    out, s = [], 0
    for i in range(m):
        w = base + (1 if i < extra else 0)
        out.append((s, s + w))
        s += w
    return tuple(out)


def make_band_plan(bits: int, threshold: int, m: int, n: int = 1) -> BandPlan:
    bands = layout(bits, m)
    r = threshold // m
    probes = sum(sum(comb(e - s, j) for j in range(r + 1)) for s, e in bands)
    cands = sum(sum(comb(e - s, j) for j in range(r + 1)) * n / 2.0 ** (e - s) for s, e in bands)
    return BandPlan(bits, threshold, bands, r, probes, cands)


def min_bands(bits: int) -> int:
    return -(-bits // 63)           # every band must fit a BIGINT


def pigeonhole_plan(bits: int, threshold: int) -> BandPlan:
    """``t + 1`` exact bands (radius 0), or more when needed to fit 63-bit keys."""
    return make_band_plan(bits, threshold, min(bits, max(threshold + 1, min_bands(bits))))


def whole_plan(bits: int, threshold: int, n: int) -> BandPlan:
    """One band of no bits, which all rows share: every pair is compared, in tiles."""
    return BandPlan(bits, threshold, ((0, 0),), 0, -(-n // own_rows(n)), float(n))


def own_rows(n: int) -> int:
    """Own rows of a tile, for ``n`` fingerprints."""
    return max(OWN_ROWS, min(4 * OWN_ROWS, n // BLOCKS))


def plan_bands(n: int, bits: int, threshold: int, max_probes: int = 20000) -> BandPlan:
    """Band count with the least estimated work per row for ``n`` fingerprints.

    Work per row = probe rows (variants within the radius) + expected candidates
    assuming uniform bits. Bands must fit a BIGINT (<= 63 bits).
    """
    best = None
    lo = min_bands(bits)
    for m in range(lo, max(lo, min(bits, threshold + 1)) + 1):
        p = make_band_plan(bits, threshold, m, n)
        if p.probes_per_row > max_probes:
            continue
        if best is None or p.est_rows < best.est_rows:
            best = p
    return best or pigeonhole_plan(bits, threshold)


def _with_comp(base: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return base.withColumn("_comp", F.col("id"))
    c = comp.select(F.col("id"), F.col("component").alias("_c"))
    return base.join(c, "id", "left").withColumn("_comp", F.coalesce("_c", "id")).drop("_c")


def band_index(reps: DataFrame, n_words: int, plan: BandPlan, rep_col: str = "rep",
               fp_col: str = "fp") -> DataFrame:
    """Index rows (id, w0.., band, key): every representative under each exact band value."""
    keys = _band_keys(n_words, plan)
    base = with_words(reps.select(F.col(rep_col).alias("id"), fp_col), fp_col, n_words).drop(fp_col)
    rows = base.select("id", *word_names("w", n_words), F.posexplode(keys).alias("band", "key"))
    return rows.where(_used_band("band", plan))


def _band_keys(n_words: int, plan: BandPlan) -> Column:
    """The value of each band; 0 for a band that the plan leaves out, and for one of no bits."""
    return F.array(*[extract_bits(word_names("w", n_words), s, e) if r >= 0 and e > s else F.lit(0).cast("bigint")
                     for (s, e), r in zip(plan.bands, plan.allowed)])


def _used_band(band: str, plan: BandPlan) -> Column:
    left_out = [i for i, r in enumerate(plan.allowed) if r < 0]
    return ~F.col(band).isin(left_out) if left_out else F.lit(True)


def _probe_keys(key: Column, plan: BandPlan) -> Column:
    """All values within the band's radius of ``key``, by the column ``band``."""
    def variants(width: int, radius: int) -> Column:
        masks = masks_within(width, radius)
        if len(masks) <= VARIANTS_INLINE:        # plain XOR expressions, compiled with the stage
            return F.array(*[key.bitwiseXOR(F.lit(m)) for m in masks])
        return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: key.bitwiseXOR(m))

    of_shape: dict[tuple[int, int], list[int]] = {}
    for i, ((s, e), r) in enumerate(zip(plan.bands, plan.allowed)):
        if r >= 0:
            of_shape.setdefault((e - s, r), []).append(i)
    shapes = list(of_shape.items())
    out = variants(*shapes[-1][0])
    for shape, bands in shapes[:-1]:
        out = F.when(F.col("band").isin(bands), variants(*shape)).otherwise(out)
    return out


def _tiled_rows(reps: DataFrame, n_words: int, plan: BandPlan, rep_col: str, fp_col: str, comp: DataFrame | None) -> DataFrame:
    """(id, [comp], words, TILE, place): the rows of each tile side by side, as ``operators.buckets`` takes them."""
    words = word_names("w", n_words)
    base = with_words(reps.select(F.col(rep_col).alias("id"), fp_col), fp_col, n_words).drop(fp_col).dropna()
    base = _with_comp(base.select("id", *words, _band_keys(n_words, plan).alias("_keys")), comp)
    rows = base.select("id", F.col("_comp").alias("comp"), *words, F.posexplode("_keys").alias("band", "key"))
    rows = rows.where(_used_band("band", plan))
    n = reps.count()
    full = full_buckets(rows.select("band", "key"), plan, own_rows(n)) if n > own_rows(n) else None
    if plan.radius <= 0:
        rows = rows.withColumn("guest", F.lit(False))
    else:
        # of two buckets within the radius the rows of the smaller key are guests in the other
        probes = rows.withColumn("probe", F.explode(_probe_keys(F.col("key"), plan))).where(F.col("probe") >= F.col("key"))
        rows = probes.select("id", "comp", *words, "band", F.col("probe").alias("key"), (F.col("probe") != F.col("key")).alias("guest"))
    tile = list(TILE)
    rows = _in_tiles(rows, full).select("id", *(["comp"] if comp is not None else []), *words, *tile, "right")
    # sorted by one long, the side in its last bit: a radix sort, and near_pairs parts the tiles that share a hash
    place = F.xxhash64(*tile).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("right").cast("bigint"))
    # a whole table's tiles are few bytes and much work: a partition for each, which aren't joined by their bytes
    blocks = plan.probes_per_row if plan.bands == ((0, 0),) else 0
    dealt = rows.repartition(blocks * (blocks + 1) // 2, *tile) if blocks > 1 else rows.repartition(*tile)
    return dealt.withColumn("place", place).drop("right").sortWithinPartitions("place")


def band_pairs(reps: DataFrame, n_words: int, plan: BandPlan, rep_col: str = "rep",
               fp_col: str = "fp", comp: DataFrame | None = None) -> DataFrame:
    """All pairs (src < dst) of ``reps`` within ``plan.threshold``: (src, dst, distance).

    With ``comp`` (id, component) only pairs across different components are
    emitted.
    """
    rows = _tiled_rows(reps, n_words, plan, rep_col, fp_col, comp)
    bands = [(i, [m % (1 << 64) for m in _word_masks(s, e, n_words)], r)
             for i, ((s, e), r) in enumerate(zip(plan.bands, plan.allowed)) if r >= 0]
    of_id = rows.schema["id"].dataType
    schema = T.StructType().add("x", of_id).add("y", of_id).add("distance", "integer")
    met = rows.mapInArrow(near_pairs(n_words, plan.threshold, bands, comp is not None), schema)
    met = met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "distance")
    return met.where(F.col("src") < F.col("dst"))


def band_links(reps: DataFrame, n_words: int, plan: BandPlan, rep_col: str = "rep", fp_col: str = "fp") -> DataFrame:
    """Links (src < dst) that connect all that the pairs of ``band_pairs`` connect.

    Each tile returns fewer links than it has rows, so they grow as the probes do and not as the pairs of a dense cluster.
    """
    rows = _tiled_rows(reps, n_words, plan, rep_col, fp_col, None)
    of_id = rows.schema["id"].dataType
    met = rows.mapInArrow(near_links(n_words, plan.threshold), T.StructType().add("x", of_id).add("y", of_id))
    met = met.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    return met.where(F.col("src") < F.col("dst"))


def full_buckets(values: DataFrame, plan: BandPlan, most_own: int) -> DataFrame | None:
    """(band, key, owns, guests): blocks of the buckets with more than ``most_own`` rows or about GUEST_ROWS guests; None if there are none.

    ``values`` has (band, key) of every row. A bucket's guests come from the keys within the band's radius; keys
    of few rows are left out there, as all of them together bring less than half of GUEST_ROWS.
    """
    sizes = cut_lineage(values.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")))
    own = sizes.select("band", "key", F.col("n").alias("own"), F.lit(0).cast("bigint").alias("guest"))
    if plan.radius > 0:
        most = max(sum(comb(e - s, j) for j in range(r + 1)) for (s, e), r in zip(plan.bands, plan.allowed) if r >= 0)
        heavy = sizes.where(F.col("n") * 2 * most >= GUEST_ROWS)
        heavy = heavy.withColumn("probe", F.explode(_probe_keys(F.col("key"), plan))).where(F.col("probe") > F.col("key"))
        own = own.unionByName(heavy.select("band", F.col("probe").alias("key"), F.lit(0).cast("bigint").alias("own"), F.col("n").alias("guest")))
        own = own.groupBy("band", "key").agg(F.sum("own").alias("own"), F.sum("guest").alias("guest"))
    exact = [i for i, r in enumerate(plan.allowed) if r <= 0]
    none = F.col("band").isin(exact) if exact else F.lit(False)
    full = own.where((F.col("own") > most_own) | (2 * F.col("guest") > GUEST_ROWS)).select(
        "band", "key", F.greatest(F.lit(1), F.ceil(F.col("own") / most_own)).cast("int").alias("owns"),
        F.when(none, 0).otherwise(F.ceil(F.col("guest") / GUEST_ROWS + F.lit(0.5))).cast("int").alias("guests"))
    full = cut_lineage(full)
    return None if full.isEmpty() else full


def _in_tiles(rows: DataFrame, full: DataFrame | None) -> DataFrame:
    """``rows`` with (low, high, right): the pairs of blocks of its bucket in which each row is compared, and the side.

    A full bucket's own rows are cut into k blocks and its guests into g more, by a hash of the id. A row of block b stands on the
    left of the tiles (b, j >= b), if it is no guest, and on the right of (i < b, b). So a bucket spreads over k * (k + 1) / 2 + k * g
    tiles; any two of its rows that aren't both guests meet in one of them.
    """
    if full is None:
        return rows.withColumns({"low": F.lit(0), "high": F.lit(0), "right": F.col("guest")})
    cut = rows.join(size_checked_broadcast(full), ["band", "key"], "left")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.col(n))).cast("int")

    def place(low, high, right: bool) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), F.lit(right).alias("right"))

    none = F.array().cast("array<struct<low:int,high:int,right:boolean>>")
    own, guest = block("owns"), F.col("owns") + block("guests")
    on_left = F.transform(F.sequence(own, F.col("owns") + F.col("guests") - 1), lambda j: place(own, j, False))
    on_right = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1), lambda i: place(i, own, True))).otherwise(none)
    as_guest = F.transform(F.sequence(F.lit(0), F.col("owns") - 1), lambda i: place(i, guest, True))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.col("guest").alias("right")))
    places = F.when(F.col("owns").isNull(), whole).when(F.col("guest"), as_guest).otherwise(F.concat(on_left, on_right))
    return cut.withColumn("_at", F.explode(places)).select(*rows.columns, "_at.*")


# ---------------------------------------------------------------------------
# bit-sampling LSH
# ---------------------------------------------------------------------------

def lsh_params(num_items: int) -> tuple[int, int]:
    """(tables, bits per table) by collection size, as the original tool chose them."""
    for bound, tables, k in C.LSH_SIZE_TIERS:
        if bound is None or num_items < bound:
            return tables, k
    raise AssertionError


def lsh_positions(tables: int, bits_per_table: int, hash_bits: int = 256,
                  seed: int = C.LSH_SEED) -> list[list[int]]:
    """Sorted sampled bit positions per table; drawn on the driver, embedded as literals."""
    rng = random.Random(seed)
    return [sorted(rng.sample(range(hash_bits), bits_per_table)) for _ in range(tables)]


def lsh_keys(word_cols: list[str], positions: list[list[int]]) -> Column:
    return F.array(*[pack_bits(word_cols, pos) for pos in positions])


def lsh_buckets(reps: DataFrame, n_words: int, positions, rep_col: str = "rep",
                fp_col: str = "fp") -> DataFrame:
    """Inverted index rows (table_idx, bucket_key, id)."""
    base = with_words(reps.select(F.col(rep_col).alias("id"), fp_col), fp_col, n_words)
    return base.select(F.posexplode(lsh_keys(word_names("w", n_words), positions))
                       .alias("table_idx", "bucket_key"), "id")


def _position_masks(positions, n_words: int) -> list[list[int]]:
    out = []
    for pos in positions:
        masks = [0] * n_words
        for p in pos:
            masks[p // 64] |= 1 << (63 - p % 64)
        out.append([m - (1 << 64) if m >= 1 << 63 else m for m in masks])
    return out


def _masked_keys(word_cols: list[str], positions, n_words: int) -> Column:
    """Per table, the fingerprint words ANDed with the table's position masks.

    Equal masked words <=> equal sampled bits, so these serve as the bucket
    identity in joins without packing bits one by one.
    """
    masks = _position_masks(positions, n_words)
    return F.array(*[F.struct(*[F.col(w).bitwiseAND(F.lit(m[k])).alias(f"k{k}") for k, w in enumerate(word_cols)])
                     for m in masks])


#: Rows of a bucket that one task compares with each other; fuller buckets are cut into tiles.
TILE_ROWS = 2_000


def bucket_tiles(index: DataFrame, bucket_cols: list[str], rows: int = TILE_ROWS) -> DataFrame | None:
    """(bucket_cols, blocks) of the buckets with more than ``rows`` rows; None if there are none."""
    full = index.groupBy(*bucket_cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    full = cut_lineage(full.select(*bucket_cols, F.expr(f"CAST((n + {rows - 1}) div {rows} AS INT)").alias("blocks")))
    return None if full.isEmpty() else full


def tiled(side: DataFrame, id_col: str, bucket_cols: list[str], tiles: DataFrame | None, as_left: bool) -> DataFrame:
    """``side`` with (low, high): the pairs of blocks of its bucket in which each row is compared.

    A bucket cut into k blocks (by a hash of the id) has k * (k + 1) / 2 pairs of blocks; a row of block b stands
    on the left of the pairs (b, j >= b) and on the right of (i <= b, b). As part of the
    join key they spread a bucket over that many tasks; every pair of rows meets in one of them.
    """
    if tiles is None:
        return side.withColumns({"low": F.lit(0), "high": F.lit(0)})
    cut = side.join(tiles, bucket_cols, "left")
    cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    others = F.sequence("block", F.col("blocks") - 1) if as_left else F.sequence(F.lit(0), F.col("block"))
    cut = cut.withColumn("other", F.explode(others))
    low, high = ("block", "other") if as_left else ("other", "block")
    return cut.withColumns({"low": F.col(low), "high": F.col(high)}).drop("blocks", "block", "other")


def _lsh_side(df: DataFrame, id_name: str, names: list[str], positions, n_words: int,
              rep_col: str, fp_col: str, comp: DataFrame | None = None) -> DataFrame:
    base = with_words(df.select(F.col(rep_col).alias("id"), fp_col), fp_col, n_words)
    base = _with_comp(base, comp)
    base = base.select(F.col("id").alias(id_name), F.col("_comp").alias(f"{id_name}_comp"),
                       *[F.col(f"w{i}").alias(n) for i, n in enumerate(names)],
                       _masked_keys(word_names("w", n_words), positions, n_words).alias("_keys"))
    ex = base.select(id_name, f"{id_name}_comp", *names, F.posexplode("_keys").alias("table_idx", "_k"))
    return ex.select(id_name, f"{id_name}_comp", *names, "table_idx",
                     *[F.col(f"_k.k{k}").alias(f"k{k}") for k in range(n_words)])


def lsh_index(reps: DataFrame, n_words: int, positions, rep_col: str = "rep", fp_col: str = "fp") -> DataFrame:
    """Index rows (id, w0.., table_idx, k0..): every representative under each table's bucket."""
    side = _lsh_side(reps, "id", word_names("w", n_words), positions, n_words, rep_col, fp_col)
    return side.drop("id_comp")


def _first_collision(aw: list[str], bw: list[str], positions, n_words: int) -> Column:
    first = None
    for i, masks in enumerate(_position_masks(positions, n_words)):
        cond = None
        for a, b, m in zip(aw, bw, masks):
            if m == 0:
                continue
            c = F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(m)) == 0
            cond = c if cond is None else cond & c
        first = F.when(cond, F.lit(i)) if first is None else first.when(cond, F.lit(i))
    return first


def _key_match(left: DataFrame, right: DataFrame, n_words: int) -> Column:
    cond = left["table_idx"] == right["table_idx"]
    for k in range(n_words):
        cond = cond & (left[f"k{k}"] == right[f"k{k}"])
    return cond


def lsh_pairs(reps: DataFrame, n_words: int, positions, threshold: int | None,
              rep_col: str = "rep", fp_col: str = "fp", comp: DataFrame | None = None,
              tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (src < dst) colliding in at least one table, each once.

    With ``threshold`` the pairs are verified (distance <= threshold) inside the
    join; without it every distinct candidate pair is returned (``distance`` too).
    A bucket of more than ``tile_rows`` rows is compared in tiles, each a key of the join.
    """
    aw, bw = word_names("a", n_words), word_names("b", n_words)
    bucket = ["table_idx", *[f"k{k}" for k in range(n_words)]]
    left = _lsh_side(reps, "src", aw, positions, n_words, rep_col, fp_col, comp)
    right = _lsh_side(reps, "dst", bw, positions, n_words, rep_col, fp_col, comp)
    tiles = bucket_tiles(left.select(*bucket), bucket, tile_rows)
    left, right = tiled(left, "src", bucket, tiles, True), tiled(right, "dst", bucket, tiles, False)
    d = distance(aw, bw)
    # in a tile of one block with itself each pair meets twice, in a tile of two blocks once
    once = (left["low"] < left["high"]) | (F.col("src") < F.col("dst"))
    cond = (_key_match(left, right, n_words) & (left["low"] == right["low"]) & (left["high"] == right["high"]) & once
            & (_first_collision(aw, bw, positions, n_words) == left["table_idx"]))
    if threshold is not None:
        cond = cond & (d <= threshold)
    if comp is not None:
        cond = cond & (F.col("src_comp") != F.col("dst_comp"))
    met = left.join(right, cond)
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), d.alias("distance"))


# ---------------------------------------------------------------------------
# strategy
# ---------------------------------------------------------------------------

def lsh_recall(tables: int, bits_per_table: int, hash_bits: int, d: int) -> float:
    """Probability that a pair at distance ``d`` collides in at least one table.

    Positions are sampled without replacement, so one table matches with
    C(hash_bits - d, k) / C(hash_bits, k).
    """
    if bits_per_table > hash_bits - d:
        p = 0.0
    else:
        p = comb(hash_bits - d, bits_per_table) / comb(hash_bits, bits_per_table)
    return 1.0 - (1.0 - p) ** tables


def solve_lsh_params(n: int, threshold: int, hash_bits: int = 256, target_recall: float = 0.99,
                     max_tables: int = 200) -> tuple[int, int]:
    """(tables, bits per table) reaching ``target_recall`` at d = threshold with the least
    expected work per item (tables + expected colliding candidates under uniform bits)."""
    best = None
    for k in range(1, min(63, hash_bits) + 1):
        if k > hash_bits - threshold:
            break
        p = comb(hash_bits - threshold, k) / comb(hash_bits, k)
        if p <= 0.0:
            continue
        if p >= 1.0:
            tables = 1
        else:
            import math
            tables = math.ceil(math.log(1.0 - target_recall) / math.log(1.0 - p))
        if tables > max_tables:
            continue
        work = tables * (1.0 + n / 2.0 ** k)
        if best is None or work < best[0]:
            best = (work, tables, k)
    if best is None:
        raise ValueError("no LSH parameters reach the target recall; use the exact band join")
    return best[1], best[2]


@dataclass(frozen=True)
class Strategy:
    kind: str                 # "bands" (exact) or "lsh" (approximate)
    band_plan: BandPlan | None = None
    tables: int = 0
    bits_per_table: int = 0


def choose_strategy(n: int, bits: int, threshold: int, use_lsh: bool = False,
                    lsh_tables_bits: tuple[int, int] | None = None, target_recall: float = 0.99,
                    plan: BandPlan | None = None) -> Strategy:
    """The exact band join at every size (by ``plan``, if given), unless LSH is asked for.

    ``use_lsh=True`` takes ``lsh_tables_bits`` = (tables, bits per table) when given,
    else tables and bits solved for ``target_recall`` at d = threshold; it is an
    error when none reach it. LSH misses pairs by design.
    """
    if not use_lsh:
        return Strategy("bands", band_plan=plan or plan_bands(n, bits, threshold))
    tables, k = lsh_tables_bits or solve_lsh_params(n, threshold, bits, target_recall)
    return Strategy("lsh", tables=tables, bits_per_table=k)


def validate_threshold(threshold, bits: int = 256) -> int:
    if isinstance(threshold, bool) or not isinstance(threshold, int):
        raise ValueError("threshold must be an integer")
    if threshold < 0 or threshold > bits:
        raise ValueError(f"threshold must be between 0 and {bits}")
    return threshold


# ---------------------------------------------------------------------------
# LSH probes and statistics
# ---------------------------------------------------------------------------

BROADCAST_MAX_ROWS = 1_000_000


def size_checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only after counting the side (``limit`` keeps the check cheap)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def lsh_probe(probes: DataFrame, index_reps: DataFrame, n_words: int, positions,
              rep_col: str = "rep", fp_col: str = "fp", exclude_self: bool = False) -> DataFrame:
    """(probe, id): index rows sharing at least one bucket with each probe, each pair once.

    ``exclude_self`` drops the pair of a probe with the index row of its own id.
    """
    aw, bw = word_names("a", n_words), word_names("b", n_words)
    left = size_checked_broadcast(_lsh_side(probes, "probe", aw, positions, n_words, rep_col, fp_col)
                                  .drop("probe_comp"))
    right = _lsh_side(index_reps, "id", bw, positions, n_words, rep_col, fp_col).drop("id_comp")
    cond = _key_match(left, right, n_words) & (
        _first_collision(aw, bw, positions, n_words) == left["table_idx"])
    if exclude_self:
        cond = cond & (F.col("probe") != F.col("id"))
    return left.join(right, cond).select("probe", "id", distance(aw, bw).alias("distance"))


def lsh_index_stats(buckets: DataFrame, tables: int, bits_per_table: int) -> DataFrame:
    """Tables, bits, items, non-empty buckets and mean bucket size, in one aggregate."""
    s = buckets.agg(F.countDistinct("id").cast("bigint").alias("total_items"),
                    F.countDistinct("table_idx", "bucket_key").cast("bigint").alias("non_empty_buckets"),
                    F.count(F.lit(1)).alias("_items"))
    return s.select(
        F.lit(tables).alias("num_tables"), F.lit(bits_per_table).alias("bits_per_table"), "total_items",
        "non_empty_buckets",
        F.round(F.col("_items").cast("double") / F.greatest(F.lit(1), F.col("non_empty_buckets")), 6)
        .alias("avg_bucket_size"))


def lsh_estimate(buckets: DataFrame) -> DataFrame:
    """Upper bound of candidate pairs: sum of n(n-1)/2 over buckets (repeats across tables)."""
    per = buckets.groupBy("table_idx", "bucket_key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("bigint").alias("estimated_pairs"))


def lsh_run_stats(reps: DataFrame, candidate_pairs: DataFrame, threshold: int) -> DataFrame:
    """Items, candidates, comparisons, verified pairs, mean candidates and reduction (one aggregate)."""
    u = reps.select(F.lit(True).alias("_rep"), F.lit(None).cast("int").alias("distance")).unionByName(
        candidate_pairs.select(F.lit(False).alias("_rep"), "distance"))
    j = u.agg(F.count_if(F.col("_rep")).cast("bigint").alias("total_images"),
              F.count_if(~F.col("_rep")).cast("bigint").alias("total_comparisons"),
              F.count_if(~F.col("_rep") & (F.col("distance") <= threshold)).cast("bigint")
              .alias("duplicate_pairs_found"))
    nn, cc = F.col("total_images"), F.col("total_comparisons")
    brute = F.expr("total_images * (total_images - 1) div 2")
    return j.select(
        "total_images", (cc * 2).alias("total_candidates"), "total_comparisons", "duplicate_pairs_found",
        F.round(F.when(nn == 0, F.lit(0.0)).otherwise(cc * 2.0 / nn), 6).alias("avg_candidates_per_image"),
        F.round(F.when(brute == 0, F.lit(0.0)).otherwise(F.lit(1.0) - cc / brute.cast("double")), 6)
        .alias("reduction_ratio"))


def collection_sizes(spark, sf_dir: str) -> DataFrame:
    """Sizes that drive the LSH parameter choice, counted from the tables."""
    from neardup.operators.exact import exact_hash_groups
    from neardup.sources.fixtures import manifest_docs
    from neardup.sources.tables import read_table
    m = manifest_docs(spark, sf_dir, with_fp=False)
    v = m.where(F.col("error").isNull())
    cand = v.where(F.col("error").isNull()).join(exact_hash_groups(v).select("file_hash"), "file_hash", "left_anti")
    docs = m.agg(F.lit("documents").alias("collection"), F.count(F.lit(1)).cast("bigint").alias("n"))
    return docs.unionByName(
        cand.agg(F.lit("candidates").alias("collection"), F.count(F.lit(1)).cast("bigint").alias("n"))).unionByName(
        read_table(spark, sf_dir, "embeddings").agg(F.lit("embeddings").alias("collection"),
                                                   F.count(F.lit(1)).cast("bigint").alias("n")))


def lsh_param_columns(sizes: DataFrame) -> DataFrame:
    """Size-tier (tables, bits per table) as column expressions over ``n``."""
    t = k = None
    for bound, tables, bits in C.LSH_SIZE_TIERS:
        if bound is None:
            t, k = t.otherwise(F.lit(tables)), k.otherwise(F.lit(bits))
        else:
            c = F.col("n") < bound
            t = F.when(c, F.lit(tables)) if t is None else t.when(c, F.lit(tables))
            k = F.when(c, F.lit(bits)) if k is None else k.when(c, F.lit(bits))
    return sizes.select("collection", "n", t.alias("num_tables"), k.alias("bits_per_table"))


def lsh_cost_columns(params: DataFrame) -> DataFrame:
    """Expected comparisons under random bits: bucket = n / 2^k, candidates per item
    = min(n - 1, max(0, bucket - 1) * tables * overlap), comparisons = n * candidates / 2."""
    n = F.col("n")
    bucket = n.cast("double") / F.pow(F.lit(2.0), F.col("bits_per_table"))
    per_item = F.least(n - F.lit(1.0), F.greatest(
        F.lit(0.0), F.greatest(F.lit(0.0), bucket - F.lit(1.0)) * F.col("num_tables") * F.lit(C.LSH_OVERLAP_FACTOR)))
    out = params.select("*", F.expr("n * (n - 1) div 2").cast("bigint").alias("brute_force_comparisons"),
                        F.floor(n * per_item / F.lit(2.0)).cast("bigint").alias("estimated_lsh_comparisons"))
    bf, est = F.col("brute_force_comparisons"), F.col("estimated_lsh_comparisons")
    return out.select("*",
                      F.round(F.lit(1.0) - est.cast("double") / F.greatest(F.lit(1), bf), 6).alias("estimated_reduction"),
                      F.round(bf.cast("double") / F.greatest(F.lit(1), est), 6).alias("speedup_factor"))


# ---------------------------------------------------------------------------
# hot buckets
# ---------------------------------------------------------------------------

HOT_BUCKET_ROWS = 20_000


def largest_bucket(index: DataFrame, bucket_cols: list[str]) -> int:
    """Size of the fullest bucket (a partial aggregate, one small job)."""
    return index.groupBy(*bucket_cols).count().agg(F.max("count")).first()[0] or 0


def leader_edges(index: DataFrame, bucket_cols: list[str], n_words: int, threshold: int) -> DataFrame:
    """(src, dst) for every bucket member within ``threshold`` of its bucket's leader (smallest id).

    O(rows) edges however full a bucket is: the leader table has one row per
    bucket, and AQE splits the member side of a hot bucket across tasks.
    """
    ww = word_names("w", n_words)
    lw = word_names("l", n_words)
    leaders = cut_lineage(index.groupBy(*bucket_cols).agg(F.min("id").alias("leader")))
    words = index.select(F.col("id").alias("leader"), *[F.col(w).alias(l) for w, l in zip(ww, lw)]) \
        .dropDuplicates(["leader"])
    lead = leaders.join(words, "leader")
    j = index.join(lead, bucket_cols).where(F.col("id") != F.col("leader"))
    return j.where(distance(ww, lw) <= threshold).select(F.col("id").alias("src"), F.col("leader").alias("dst"))
