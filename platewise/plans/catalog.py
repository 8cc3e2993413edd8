"""The registered queries: each runs an operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import categories as C
from platewise.operators import correlate as R
from platewise.operators import distance as D
from platewise.operators import doseresponse as M
from platewise.operators import embedding as E
from platewise.operators import emd as W
from platewise.operators import identity as I
from platewise.operators import pooling as P
from platewise.operators import qc as Q
from platewise.operators import scaling as S
from platewise.operators import standardize as T
from platewise.operators import subsets as U
from platewise.operators import violin as V
from platewise.operators.ordered import group_quantiles, long_form, table_quantiles
from platewise.plans import inputs as X
from platewise.plans import profile as A
from platewise.plans.inputs import MEASURES, ROLES, rnd, rounded, scored
from platewise.session import new_folder, stage
from platewise.sources import tables as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STANDARDIZED = tuple(f"rp_norm_{f}" for f in MEASURES)
#: What no score reads: a stage would write it.
UNREAD = (ROLES.cell, ROLES.well_key)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- pooling ---------------------------------------------------------------------------------


@query
def pool_cells(spark, sf):
    out = P.pool_cells(X.object_tables(spark, sf), ROLES)
    return rounded(out, [c for c in out.columns if c.startswith("l_")])


@query
def pool_wells(spark, sf):
    out = P.pool_wells(X.object_tables(spark, sf), ROLES)
    return rounded(out, [c for c in out.columns if c.startswith("l_")])


@query
def object_counts(spark, sf):
    out = P.pool_cells(X.object_tables(spark, sf), ROLES)
    return out.select("cell_ID", *[c for c in out.columns if c.startswith("counts_")])


# ---- standardization -------------------------------------------------------------------------


def standardized(spark, sf):
    return T.standardize_row_day(X.profiles(spark, sf), ROLES)


def standardized_values(spark, sf, *unread):
    """Standardized without ids and ``unread``; both steps start from what is stored."""
    return T.standardize_row_day(X.profiles(spark, sf).drop(*UNREAD, *unread), ROLES, materialize=True).drop(ROLES.tech_rep)


def trimmed(spark, sf):
    """What scores are taken of: without the ids and the replica."""
    return T.trim_wells(stage(standardized_values(spark, sf), "standardized"), ROLES)


@query
def standardize_row_day(spark, sf):
    return rounded(standardized(spark, sf), STANDARDIZED)


@query
def robust_z(spark, sf):
    out = T.robust_z(X.profiles(spark, sf), ROLES)
    return rounded(out, [f"rZs_{f}" for f in MEASURES])


@query
def trim_wells(spark, sf):
    return rounded(T.trim_wells(X.profiles(spark, sf), ROLES), MEASURES)


@query
def trim_selected(spark, sf):
    wanted = ["rp_norm_l_tax", "rp_norm_l_quantity"]
    return rounded(T.trim_selected(standardized(spark, sf), wanted, ROLES), wanted)


# ---- earth mover's distance ------------------------------------------------------------------


def dose_scores(spark, sf):
    return W.emd_concentrations(trimmed(spark, sf), ROLES)


def control_scores(spark, sf):
    return W.emd_controls(standardized(spark, sf), ROLES)


@query
def emd_concentrations(spark, sf):
    return scored(dose_scores(spark, sf))


@query
def emd_controls(spark, sf):
    return scored(control_scores(spark, sf))


@query
def emd_event_types(spark, sf):
    kinds = ["click", "error", "purchase", "signup", "view"]
    got = W.emd_pairs(X.event_long(spark, sf), ["Metadata_Day", "feature"], "event_type", kinds)
    names = F.array(*[F.lit(k) for k in kinds])
    return got.select(
        "Metadata_Day",
        F.get(names, F.col("first")).alias("Population1"),
        F.get(names, F.col("second")).alias("Population2"),
        "Count1", "Count2", rnd("EMD_score", 6).alias("EMD_score"),
    )


@query
def rank_features(spark, sf):
    return rounded(W.rank_features(dose_scores(spark, sf)), ["median_emd"])


@query
def score_panels(spark, sf):
    scores = stage(dose_scores(spark, sf), "dose-scores")
    out = W.score_panels(W.against_control(scores, ROLES))
    return scored(rounded(out, ["median_emd"]))


@query
def classify_features(spark, sf):
    out = W.classify_features(W.against_control(dose_scores(spark, sf), ROLES), control_scores(spark, sf))
    return rounded(out, ["control_mean", "threshold"])


@query
def select_high_low(spark, sf):
    return W.select_high_low(W.against_control(dose_scores(spark, sf), ROLES), control_scores(spark, sf))


# ---- violin statistics -----------------------------------------------------------------------


@query
def group_stats(spark, sf):
    clean = S.sanitize_columns(X.flawed_profiles(spark, sf), MEASURES)
    got = V.group_stats(clean, ["Metadata_Day", "Concentration"], MEASURES)
    return rounded(got, ["median", "mean"])


@query
def kruskal_events(spark, sf):
    got = V.kruskal(X.event_long(spark, sf), ["Metadata_Day", "feature"], "event_type")
    return got.select("Metadata_Day", "groups", "n", rnd("h").alias("h"), rnd("p").alias("p"), "significant")


def dose_test(spark, sf):
    long = long_form(X.profiles(spark, sf), ["Metadata_Day", "Concentration"], MEASURES)
    return V.kruskal(long, ["feature", "Metadata_Day"], "Concentration")


@query
def kruskal_parts(spark, sf):
    """Hundreds of levels: one per part."""
    items = X.table(spark, sf, "lineitem")
    long = items.select(F.lit("l_quantity").alias("feature"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("value"))
    return rounded(V.kruskal(long, ["feature"], "part"), ["h", "p"])


@query
def kruskal_doses(spark, sf):
    return rounded(dose_test(spark, sf), ["h", "p"])


@query
def mean_difference_flags(spark, sf):
    keys = ["Metadata_Day", "Concentration"]
    stats = V.group_stats(standardized(spark, sf), keys, STANDARDIZED)
    long = long_form(standardized(spark, sf), keys, STANDARDIZED)
    tested = V.kruskal(long, ["feature", "Metadata_Day"], "Concentration")
    got = V.mean_difference_flags(stats, ["feature", "Metadata_Day"], "Concentration", tested)
    return rounded(got, ["median", "mean"])


# ---- subsets ---------------------------------------------------------------------------------


@query
def stratum_counts(spark, sf):
    return U.stratum_counts(X.profiles(spark, sf), ROLES)


@query
def sample_capped(spark, sf):
    return U.sample_capped(X.profiles(spark, sf), ROLES, cap=900).select("cell_ID", "Metadata_Day", "Concentration")


@query
def sample_capped_without_top_dose(spark, sf):
    return U.sample_capped(X.profiles(spark, sf), ROLES, cap=900, exclude=(2,)).select("cell_ID", "Metadata_Day", "Concentration")


@query
def sample_equal(spark, sf):
    return U.sample_equal(X.profiles(spark, sf), ROLES).select("cell_ID", "Metadata_Day", "Concentration")


@query
def sample_by_cap(spark, sf):
    return U.sample_by_cap(X.profiles(spark, sf), ROLES, {2: 900, 3: 1200}, 1500).select("cell_ID", "Metadata_Day", "Concentration")


def _flawed_with_flat(spark, sf):
    flawed = X.flawed_profiles(spark, sf)
    holes = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax"))
    flat = F.when(F.col("l_orderkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(2.5))
    return flawed.withColumns({"holes": holes, "flat": flat, "Number_Object_Number_x": F.col("l_quantity")})


@query
def filter_report(spark, sf):
    names = [*MEASURES, "holes", "flat", "Number_Object_Number_x"]
    got = U.filter_report(_flawed_with_flat(spark, sf), names, excluded=("l_discount",))
    return rounded(got, ["missing_percent"])


@query
def filter_summary(spark, sf):
    names = [*MEASURES, "holes", "flat", "Number_Object_Number_x"]
    return U.filter_summary(U.filter_report(_flawed_with_flat(spark, sf), names, excluded=("l_discount",)))


@query
def filter_features(spark, sf):
    got = U.filter_features(_flawed_with_flat(spark, sf).drop("l_orderkey"), ROLES, excluded=("l_discount",))
    return rounded(got, ["l_quantity", "l_extendedprice", "l_tax"])


# ---- dose response ---------------------------------------------------------------------------


@query
def dose_series(spark, sf):
    got = M.dose_series(dose_scores(spark, sf), ROLES)
    return got.select("Feature", "Day", F.posexplode("y").alias("x", "y")).withColumn("y", rnd("y"))


@query
def fit_lines(spark, sf):
    n = len(M.fitted_doses(ROLES))
    series = stage(M.dose_series(dose_scores(spark, sf), ROLES), "dose-series")
    line = M.fit_linear(series, n).select("Feature", "Day", "Slope", "Intercept", F.col("ssr").alias("line_ssr"))
    flat = M.fit_constant(series, n).select("Feature", "Day", "Level", F.col("ssr").alias("level_ssr"))
    return rounded(line.join(flat, ["Feature", "Day"]), ["Slope", "Intercept", "line_ssr", "Level", "level_ssr"], 3)


def fits(spark, sf):
    return M.fit_models(dose_scores(spark, sf), ROLES)


@query
def fit_models(spark, sf):
    return rounded(fits(spark, sf), ["AIC", "BIC", "Slope"], 3)


@query
def select_features(spark, sf):
    return M.select_features(fits(spark, sf), ROLES.days)


def _shifted(spark, sf):
    """Standardized profiles with two features made to respond to the dose."""
    dose = F.col("Concentration")
    q = F.col("rp_norm_l_quantity")
    return standardized(spark, sf).withColumns({
        "rp_norm_shifted": q + (F.lit(ROLES.control) - dose) * 4,
        "rp_norm_bent": q + F.greatest(F.lit(0), F.lit(7) - dose) * 6,
    })


def _shifted_fits(spark, sf):
    p = _shifted(spark, sf)
    names = ["rp_norm_l_tax", "rp_norm_shifted", "rp_norm_bent"]
    return M.fit_models(W.emd_concentrations(T.trim_selected(p, names, ROLES), ROLES), ROLES)


@query
def fit_responding(spark, sf):
    """Fits of two features made to respond to the dose and one that does not."""
    return rounded(_shifted_fits(spark, sf), ["AIC", "BIC", "Slope"], 3)


@query
def select_responding(spark, sf):
    return M.select_features(_shifted_fits(spark, sf), ROLES.days)


# ---- correlation -----------------------------------------------------------------------------


def _wider(spark, sf):
    p = standardized_values(spark, sf, ROLES.conc)
    q, e, t = (F.col(f"rp_norm_{f}") for f in ("l_quantity", "l_extendedprice", "l_tax"))
    wide = p.withColumns({
        "rp_norm_twice": q * 2 + t, "rp_norm_negated": F.lit(0.0) - e + t, "rp_norm_even": F.lit(1.5),
        "rp_norm_holed": F.when(q > -20, q + t * 3),
    })
    return stage(wide, "wide-standardized")


@query
def feature_correlation(spark, sf):
    got = R.feature_correlation(_wider(spark, sf), ROLES)
    return got.select(
        "feature_a", "feature_b", rnd("r", 6).alias("r"), rnd(R.corr_distance("r"), 6).alias("distance")
    )


def _clusters(spark, sf):
    pairs = R.feature_correlation(_wider(spark, sf), ROLES).withColumn("distance", R.corr_distance("r"))
    return R.cluster_features(pairs)


@query
def cluster_features(spark, sf):
    return _clusters(spark, sf).select("cluster", F.explode("features").alias("feature"))


@query
def cluster_representatives(spark, sf):
    return R.representatives(_clusters(spark, sf))


@query
def cluster_sizes(spark, sf):
    return R.cluster_sizes(_clusters(spark, sf))


@query
def embedding_correlation(spark, sf):
    dims = [f"f{i}" for i in range(X.DIMENSIONS)]
    got = R.pearson_pairs(X.vectors(spark, sf), dims)
    return rounded(got, ["r"], 6)


# ---- categories ------------------------------------------------------------------------------


@query
def guess_categories(spark, sf):
    category = C.guess_category("feature")
    got = X.named_features(spark, sf).select("feature").distinct().withColumn("category", category)
    return got.withColumn("organelle", C.guess_organelle("feature", F.col("category")))


@query
def upsert_lookup(spark, sf):
    return C.upsert_lookup(X.feature_lookup(spark, sf), X.named_features(spark, sf))


@query
def duplicate_names(spark, sf):
    names = X.named_features(spark, sf).select(F.col("p_partkey").alias("pos"), F.col("feature").alias("name"))
    return C.duplicate_names(names)


@query
def category_crosstab(spark, sf):
    return C.crosstab(X.named_features(spark, sf).select("feature"), X.feature_lookup(spark, sf))


@query
def category_margins(spark, sf):
    return C.margins(X.named_features(spark, sf).select("feature"), X.feature_lookup(spark, sf))


@query
def unplaced_features(spark, sf):
    return C.unplaced(X.named_features(spark, sf).select("feature"), X.feature_lookup(spark, sf))


# ---- image quality control -------------------------------------------------------------------


def _flagged(spark, sf):
    return Q.attach_tags(X.image_manifest(spark, sf), X.tag_tables(spark, sf))


@query
def attach_tags(spark, sf):
    return _flagged(spark, sf)


@query
def removal_list(spark, sf):
    return Q.removal_list(_flagged(spark, sf))


@query
def split_manifest(spark, sf):
    manifest = X.image_manifest(spark, sf)
    files = manifest.select(F.explode(F.array(*Q.FILE_COLUMNS)).alias("file"))
    absent = manifest.where("ImageNumber % 10 = 3").select(F.concat(F.lit("absent_"), "ImageNumber").alias("remove"))
    return Q.split_manifest(files, Q.removal_list(_flagged(spark, sf)).unionByName(absent))


@query
def image_ranges(spark, sf):
    return Q.image_ranges(X.table(spark, sf, "pages"), 20)


# ---- identity and lineage --------------------------------------------------------------------


@query
def link_chain(spark, sf):
    cells, middle, nuclei = X.lineage_tables(spark, sf)
    return I.link_chain(cells, middle, nuclei)


@query
def link_via(spark, sf):
    cells, middle, _ = X.lineage_tables(spark, sf)
    relate = cells.withColumnRenamed("Parent_partialCells", "Parent_PunctaMito")
    puncta = middle.withColumnRenamed("Parent_FilteredNuclei", "Parent_Cells")
    return I.link_via(relate, puncta, "Parent_PunctaMito")


@query
def link_direct(spark, sf):
    _, middle, _ = X.lineage_tables(spark, sf)
    return I.with_id(middle, "cell_ID", "ImageNumber", "Parent_FilteredNuclei")


@query
def exclude_site(spark, sf):
    m = X.measure(spark, sf).withColumn(
        "Metadata_Site",
        F.when(F.col("l_orderkey") % 6 != 0, F.concat((F.col("l_orderkey") % 6).cast("string"), F.lit("_1"))),
    )
    return I.exclude_site(m).groupBy("Metadata_Well", "Metadata_Site").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_wells(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("Metadata_Well"))
    return I.parse_well(p, ROLES)


@query
def normalize_keys(spark, sf):
    m = X.profiles(spark, sf)
    messy = m.select(
        F.concat(F.lit(" "), F.lower("Metadata_Day"), F.lit(" ")).alias("Metadata_Day"),
        F.when(F.col("Concentration") != 5, F.lower("Metadata_Biorep")).alias("Metadata_Biorep"),
        F.concat(F.lower("Metadata_Well"), F.lit("  ")).alias("Metadata_Well"),
    )
    keyed = I.with_well_key(I.normalize_keys(messy, ROLES), ROLES)
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def drop_matching_columns(spark, sf):
    wide = X.measure(spark, sf).select(
        "cell_ID", F.col("l_quantity").alias("Texture_GrayLys"), F.col("l_tax").alias("AreaShape_01_x"),
        F.col("l_discount").alias("Intensity_GrayNuclei"), F.col("l_extendedprice").alias("Location_X"),
        F.col("l_orderkey").alias("Children_Count"),
    )
    out = I.suffix(I.drop_matching(wide, I.UNWANTED_FRAGMENTS["FilteredNuclei"]), "FilteredNuclei", ["cell_ID"])
    return rounded(out, [c for c in out.columns if c != "cell_ID"])


@query
def select_listed(spark, sf):
    return rounded(I.select_listed(X.profiles(spark, sf), ["l_tax", "l_quantity", "absent"], ROLES), ["l_tax", "l_quantity"])


@query
def remap_replicas(spark, sf):
    m = I.remap(X.profiles(spark, sf), "Tech_replica", {"C": "B", "D": "C"})
    return m.groupBy("Tech_replica", "Metadata_Day").agg(F.count(F.lit(1)).alias("n"))


@query
def highlight_bioreps(spark, sf):
    out = I.highlight(X.profiles(spark, sf), "Metadata_Biorep", ROLES.bioreps)
    return out.groupBy("highlight", "Color", "Size").agg(F.count(F.lit(1)).alias("n"))


@query
def dose_colors(spark, sf):
    return I.assign_colors(X.profiles(spark, sf), "Concentration")


@query
def day_labels(spark, sf):
    m = X.profiles(spark, sf).groupBy("Metadata_Day").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("label", I.day_label("Metadata_Day"))


# ---- imputation and scaling ------------------------------------------------------------------


@query
def sanitize_values(spark, sf):
    return rounded(S.sanitize_columns(X.flawed_profiles(spark, sf), MEASURES), MEASURES).drop("l_orderkey")


@query
def impute_mean(spark, sf):
    clean = S.sanitize_columns(X.flawed_profiles(spark, sf), MEASURES).select("cell_ID", *MEASURES)
    return rounded(S.impute_mean(clean, MEASURES), MEASURES)


@query
def impute_group_mean(spark, sf):
    clean = S.sanitize_columns(X.flawed_profiles(spark, sf), MEASURES).select("cell_ID", "Concentration", *MEASURES)
    out, known = S.impute_group_mean(clean, "Concentration", ROLES.concentrations, MEASURES)
    return rounded(out, known)


@query
def impute_median(spark, sf):
    clean = S.sanitize_columns(X.flawed_profiles(spark, sf), MEASURES).select("cell_ID", *MEASURES)
    out, known = S.impute_median(clean, MEASURES)
    return rounded(out, known)


@query
def min_max(spark, sf):
    dims = [f"f{i}" for i in range(X.DIMENSIONS)]
    return rounded(S.min_max(X.vectors(spark, sf), dims), dims, 6)


@query
def center(spark, sf):
    return rounded(S.center(X.profiles(spark, sf).select("cell_ID", *MEASURES), MEASURES), MEASURES, 8)


@query
def quantile_uniform(spark, sf):
    return rounded(S.quantile_uniform(X.profiles(spark, sf).select("cell_ID", *MEASURES), MEASURES), MEASURES, 6)


@query
def clip_scale(spark, sf):
    return rounded(S.clip_scale(X.profiles(spark, sf).select("cell_ID", *MEASURES), MEASURES), MEASURES, 6)


@query
def shuffled_rows(spark, sf):
    return rounded(S.shuffle(X.profiles(spark, sf).select("cell_ID", *MEASURES), "cell_ID"), MEASURES)


# ---- population distances and embedding ------------------------------------------------------

VECTOR_DIMS = [f"f{i}" for i in range(X.DIMENSIONS)]
DOSES_DOWN = [c for c in sorted(ROLES.concentrations, reverse=True) if c != ROLES.control]


def _populations(spark, sf):
    """Half of the levels are control, so that it has more rows than dimensions and a regular covariance."""
    v = X.vectors(spark, sf)
    return v.withColumn("Concentration", F.when(F.col("Concentration") >= 7, ROLES.control).otherwise(F.col("Concentration")))


def _ready_vectors(spark, sf):
    ready, dims = D.prepare_population(_populations(spark, sf), "Concentration", ROLES.concentrations, VECTOR_DIMS)
    return stage(ready.select("vec_id", "Concentration", *dims), "vectors")


@query
def mmd(spark, sf):
    v = _ready_vectors(spark, sf).select("Concentration", D.vector_of(VECTOR_DIMS).alias("v"))
    return rounded(D.mmd(v, "Concentration", ROLES.control, DOSES_DOWN), ["MMD_Score"], 6)


@query
def mahalanobis(spark, sf):
    v = _ready_vectors(spark, sf).select("Concentration", D.vector_of(VECTOR_DIMS).alias("v"))
    return rounded(D.mahalanobis(v, "Concentration", ROLES.control, DOSES_DOWN), ["Mahalanobis_Score"], 6)


@query
def mean_emd(spark, sf):
    v = _ready_vectors(spark, sf)
    return rounded(D.mean_emd(v, "Concentration", ROLES.control, DOSES_DOWN, VECTOR_DIMS), ["EMD_Score"], 6)


@query
def population_distances(spark, sf):
    dims = [*VECTOR_DIMS]
    v = _populations(spark, sf).select("vec_id", "Concentration", *dims)
    day = F.concat(F.lit("D"), F.get(F.array(F.lit("1"), F.lit("5"), F.lit("7"), F.lit("9")), (F.col("vec_id") % 2).cast("int")))
    roles = replace(ROLES, days=("D1", "D5"))
    got = D.distances_by_day(v.withColumn("Metadata_Day", day), roles, dims)
    return rounded(got, ["MMD_Score", "Mahalanobis_Score", "EMD_Score"], 6)


@query
def knn(spark, sf):
    e = X.table(spark, sf, "embeddings")
    return rounded(E.knn(e, "vec_id", "embedding"), ["distance"], 6)


@query
def whole_table_quantiles(spark, sf):
    """All line items as one group: ranks are found by radix passes alone."""
    probs = (0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0)
    row = table_quantiles(X.profiles(spark, sf), MEASURES, probs)
    named = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("q")) for f in MEASURES])
    rows = row.select(F.inline(named)).select("feature", F.posexplode("q").alias("at", "q"))
    return rows.select("feature", F.get(F.array(*[F.lit(p) for p in probs]), F.col("at")).alias("p"), rnd("q").alias("q"))


@query
def crowded_day_quantiles(spark, sf):
    """Days as groups too large for a task that may put 2^13 values in order, so every one of them is narrowed first."""
    got = group_quantiles(X.flawed_profiles(spark, sf), ["Metadata_Day"], MEASURES, [0.05, 0.5, 0.95], [F.count(F.lit(1)).alias("n")], 1 << 13)
    cells = [rnd(F.get(F.col(f), F.lit(i))).alias(f"{f}_{p}") for f in MEASURES for i, p in enumerate(("low", "median", "high"))]
    return got.select("Metadata_Day", "n", *cells)


@query
def density(spark, sf):
    got = E.density(X.event_values(spark, sf), ["value"])
    return rounded(got, ["x", "density"], 6)


def _embedded(spark, sf, k, scale=True):
    got = E.embed(X.vectors(spark, sf), "vec_id", VECTOR_DIMS, k, scale)
    return rounded(got, [f"dim{j + 1}" for j in range(k)], 6)


@query
def embed_doses(spark, sf):
    return _embedded(spark, sf, 2)


@query
def embed_unscaled(spark, sf):
    return _embedded(spark, sf, 2, scale=False)


@query
def embed_three_dimensions(spark, sf):
    return _embedded(spark, sf, 3)


@query
def embedding_features(spark, sf):
    v = X.vectors(spark, sf)
    holed = v.withColumn("f0", F.when(F.col("vec_id") % 5 != 0, F.col("f0")))
    coords = v.select("vec_id", rnd("f10", 6).alias("dim1"), rnd("f11", 6).alias("dim2"))
    return rounded(E.embedding_features(coords, holed, "vec_id", VECTOR_DIMS), ["value"], 6)


@query
def embedded_features(spark, sf):
    """Every dimension on the coordinates of the embedding."""
    v = X.vectors(spark, sf)
    got = E.embedding_features(E.embed(v, "vec_id", VECTOR_DIMS, 2, scale=False), v, "vec_id", VECTOR_DIMS)
    return rounded(got, ["dim1", "dim2", "value"], 6)


# ---- sources and sinks -----------------------------------------------------------------------


@query
def tsv_round_trip(spark, sf):
    path = new_folder(spark, "tsv")
    m = X.flawed_profiles(spark, sf).select("cell_ID", "Metadata_Day", *MEASURES)
    IO.write_tsv(m, path)
    schema = ", ".join(["cell_ID string", "Metadata_Day string", *[f"{f} double" for f in MEASURES]])
    back = IO.read_tsv(spark, path, schema)
    finite = {f: F.when(F.abs(f) < 1e15, F.col(f)) for f in MEASURES}
    return back.select("cell_ID", "Metadata_Day", *[rnd(v).alias(f) for f, v in finite.items()])


@query
def csv_columns(spark, sf):
    path = new_folder(spark, "csv")
    X.profiles(spark, sf).select("cell_ID", "Metadata_Day", *MEASURES).write.option("header", True).csv(path)
    return rounded(IO.read_csv(spark, path, ["cell_ID", *MEASURES[:2]]), MEASURES[:2])


@query
def scan_subsets(spark, sf):
    """One text file per day, found again by its name's pattern."""
    root = new_folder(spark, "subsets")
    m = X.profiles(spark, sf)
    for day in ROLES.days:
        own = m.where(F.col("Metadata_Day") == day).select("cell_ID", "Concentration", "l_quantity")
        IO.write_tsv(own.drop("Concentration") if day == ROLES.days[0] else own, f"{root}/{day}")
    found = IO.scan_glob(spark, root, "part-*.csv", recursive=True)
    return found.select("cell_ID", F.col("Concentration").cast("int").alias("Concentration"), rnd(F.col("l_quantity").cast("double")).alias("l_quantity"))


@query
def table_header(spark, sf):
    path = new_folder(spark, "header")
    IO.write_tsv(X.profiles(spark, sf).select("cell_ID", "Metadata_Day", *MEASURES), path)
    return IO.read_header(spark, path)


@query
def combine_instances(spark, sf):
    """The same table in every worker's folder, with and without a column."""
    root = new_folder(spark, "worker-files")
    for name, df in X.object_tables(spark, sf).items():
        narrow = df.drop("l_tax") if name == "Cytoplasm" else df
        IO.write_tsv(narrow, f"{root}/{name}")
    parts = IO.combine_instances(spark, root, "part-*.csv")
    return parts.groupBy("Subfolder").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("taxed"), rnd(F.sum(F.col("l_quantity").cast("double"))).alias("quantity"),
    )


@query
def combine_parts(spark, sf):
    root = new_folder(spark, "workers")
    for name, df in X.object_tables(spark, sf).items():
        narrow = df.drop("l_tax") if name == "Cytoplasm" else df
        IO.write_tsv(narrow, f"{root}/{name}/objects.txt")
    parts = IO.combine_parts(spark, root, "objects.txt")
    return parts.groupBy("Subfolder").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("taxed"),
        rnd(F.sum("l_quantity")).alias("quantity"),
    )


@query
def partitioned_sink(spark, sf):
    path = new_folder(spark, "strata")
    IO.write_partitioned(X.profiles(spark, sf), path, ["Metadata_Day", "Concentration"])
    back = spark.read.parquet(path)
    return back.groupBy("Metadata_Day", F.col("Concentration").cast("int").alias("Concentration")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity")).alias("quantity")
    )


@query
def feature_list_round_trip(spark, sf):
    path = new_folder(spark, "list")
    IO.write_list(X.named_features(spark, sf).select("feature").distinct(), path)
    return IO.read_list(spark, path)


@query
def lookup_round_trip(spark, sf):
    path = new_folder(spark, "lookup")
    IO.write_tsv(X.feature_lookup(spark, sf), path)
    # A file of its own, as curators leave them: notes before the header and between the rows.
    notes = ["# curated by hand", "feature\tcategory\torganelle", "# feature\tTexture\tNuclei", "#rp_norm_noted\tTexture\tOther", "rp_norm_noted\tTexture\t"]
    spark.createDataFrame([(n,) for n in notes], "value string").coalesce(1).write.mode("append").text(path)
    return IO.read_lookup(spark, path)


# ---- the whole analysis ----------------------------------------------------------------------


@query
def profile_dose_scores(spark, sf):
    return scored(A.profile_scores(spark, sf))


@query
def sampled_distances(spark, sf):
    """Sample, filter, distances: 300 rows of every day and concentration."""
    names = [*MEASURES, "holes", "flat", "Number_Object_Number_x"]
    # Ids repeat in the table, and a draw by id needs one row per id.
    cells = _flawed_with_flat(spark, sf).groupBy("cell_ID", "Metadata_Day", "Concentration").agg(*[F.max(f).alias(f) for f in names])
    got = A.sampled_distances(cells, ROLES, 300, ("l_discount",))
    return rounded(got, ["MMD_Score", "Mahalanobis_Score", "EMD_Score"], 6)


@query
def selected_profiles(spark, sf):
    """Fit, select, trim, prune by correlation, trim: the table of the features that are left."""
    std = stage(_shifted(spark, sf), "shifted")
    _, kept, table = A.selected_profiles(std, ROLES, ROLES.days)
    return rounded(table.select("cell_ID", "Metadata_Day", "Concentration", *kept), kept)
