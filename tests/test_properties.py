"""Property tests: the exact band join equals brute force for any bits / threshold."""

from hypothesis import HealthCheck, given, settings, strategies as st

from neardup.operators import hamming as H


def to_words(v, bits):
    out = []
    for k in range(bits // 64):
        w = (v >> (bits - 64 * (k + 1))) & ((1 << 64) - 1)
        out.append(w - (1 << 64) if w >= 1 << 63 else w)
    return out


@st.composite
def fingerprint_sets(draw):
    bits = draw(st.sampled_from([64, 128, 256]))
    t = draw(st.integers(min_value=0, max_value=min(48, bits)))
    base = draw(st.lists(st.integers(min_value=0, max_value=(1 << bits) - 1), min_size=1, max_size=6))
    fps = []
    for b in base:                                  # clusters of near copies around each base
        for flips in draw(st.lists(st.lists(st.integers(0, bits - 1), max_size=t + 3), max_size=5)):
            v = b
            for p in flips:
                v ^= 1 << p
            fps.append(v)
        fps.append(b)
    return bits, t, fps


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(case=fingerprint_sets())
def test_band_join_equals_brute_force(spark, case):
    bits, t, fps = case
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(i, to_words(v, bits)) for i, v in enumerate(distinct)], "rep long, fp array<long>")
    expect = {(i, j, bin(distinct[i] ^ distinct[j]).count("1")) for i in range(len(distinct))
              for j in range(i + 1, len(distinct)) if bin(distinct[i] ^ distinct[j]).count("1") <= t}
    for plan in (H.plan_bands(len(distinct), bits, t), H.pigeonhole_plan(bits, t)):
        got = {(r.src, r.dst, r.distance) for r in H.band_pairs(df, bits // 64, plan).collect()}
        assert got == expect


@st.composite
def manifests(draw):
    n = draw(st.integers(min_value=2, max_value=30))
    base = draw(st.integers(min_value=0, max_value=(1 << 256) - 1))
    rows = []
    for i in range(n):
        v = base
        for p in draw(st.lists(st.integers(0, 255), max_size=12)):
            v ^= 1 << p
        h = f"h{draw(st.integers(0, n // 2))}"          # shared hashes make exact groups
        q = float(draw(st.integers(0, 5)))
        rows.append((i, f"/p/{i:03d}.png", 100 + i, q, h, v))
    return rows


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=manifests())
def test_groups_are_partitions_with_one_keeper(spark, rows):
    import datetime as dt
    from neardup.plans.dataflow import find_duplicates
    schema = ("id long, path string, mtime timestamp, file_size long, width int, height int, pixel_count long, "
              "bit_depth int, format string, file_hash string, perceptual_hash string, fp array<long>, "
              "quality_score double, error string")

    def frame(rs):
        return spark.createDataFrame(
            [(i, p, dt.datetime(2024, 1, 1), s, 1, 1, 1, 8, "PNG", h, None, to_words(v, 256), q, None)
             for i, p, s, q, h, v in rs], schema)

    def summary(df):
        g = find_duplicates(df, threshold=8).collect()
        paths = [r.path for r in g]
        assert len(paths) == len(set(paths))                           # each row in at most one group
        keeps = {}
        for r in g:
            keeps[r.group_id] = keeps.get(r.group_id, 0) + int(r.is_best)
        assert set(keeps.values()) <= {1}                               # exactly one keeper per group
        assert sorted(keeps) == list(range(1, len(keeps) + 1))          # gap-free ids
        return sorted(sorted(p for p in {r.path for r in g if r.group_id == k}) for k in keeps)

    assert summary(frame(rows)) == summary(frame(list(reversed(rows))))  # invariant to row order
