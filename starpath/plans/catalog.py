"""The registered queries: each takes a session and a table folder and returns a frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.functions import numbers, text
from starpath.operators import (
    candidates, datasets, distincts, evaluation, foldin, ids, places, ranking, ratings as rating_ops, rejects, requests, similarity, skew,
    stored, stores, sums, tallies, topk, toplists, words,
)
from starpath.plans import als, fixtures, serving
from starpath.plans.load import load_ratings, load_top_stores
from starpath.session import cut_lineage, run_folder, set_down
from starpath.sources.buckets import read_by_user, write_by_user
from starpath.sources.lines import read_ordered_lines, write_lines
from starpath.sources.tables import read_slice, read_table, write_slices
from starpath.streaming import caps, requests as request_stream


def toplist_pack(spark: SparkSession, folder: str) -> DataFrame:
    return toplists.pack_top_lines(fixtures.top_stores(spark, folder))


def toplist_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = toplists.pack_top_lines(fixtures.top_stores(spark, folder))
    return toplists.as_store_table(toplists.parse_top_lines(lines))


def toplist_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Two generations of lines, fifty and ten stores long; the later one wins where both have the group."""
    top = cut_lineage(fixtures.top_stores(spark, folder))
    older = toplists.pack_top_lines(top).withColumn("line_order", F.lit(1))
    newer = toplists.pack_top_lines(top.filter(F.col("season") != "winter"), 10).withColumn("line_order", F.lit(2))
    return toplists.lookup_top_lines(older.unionByName(newer))


def toplist_lookup_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from text files, the older lines in a file that comes first by name."""
    run = run_folder(spark, "generations")
    top = cut_lineage(fixtures.top_stores(spark, folder))
    write_lines(toplists.pack_top_lines(top), f"{run}/lines/1")
    write_lines(toplists.pack_top_lines(top.filter(F.col("season") != "winter"), 10), f"{run}/lines/2")
    return toplists.lookup_top_lines(read_ordered_lines(spark, f"{run}/lines/*"))


def store_list(spark: SparkSession, folder: str) -> DataFrame:
    top = fixtures.top_stores(spark, folder)
    listed = toplists.store_list(top.withColumn("store_id", F.col("item_id")), " Winter ", " Las Vegas ")
    return listed.select("rank", "store_id", "name", "season", "city")


def state_city_map(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per state, the state looked up from the nation, then city from state and state from city."""
    nation = fixtures.table(spark, folder, "nation").select("n_nationkey")
    customers = fixtures.table(spark, folder, "customer").select("c_nationkey")
    states = places.with_place(nation, "n_nationkey").select("n_nationkey", "state")
    per_nation = customers.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    counted = per_nation.join(states, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("state").agg(
        F.sum("n").alias("n_customers"))
    back = places.with_state(places.with_city(counted).withColumnRenamed("state", "from_state"))
    return back.select("from_state", "city", "state", "n_customers")


def ascii_strip(spark: SparkSession, folder: str) -> DataFrame:
    documents = fixtures.table(spark, folder, "documents")
    return documents.select("doc_id", text.ascii_only(F.col("text")).alias("plain"))


def rating_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.rating_lines(fixtures.ratings(spark, folder))


def rating_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = rating_ops.parse_ratings(rating_ops.rating_lines(fixtures.ratings(spark, folder)))
    return rejects.accepted(parsed).drop("value")


def _event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rating lines: the rating is text for some types, the date too short for others."""
    events = fixtures.table(spark, folder, "events")
    date = F.when(F.col("event_type") == "view", F.lit("2024-01")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rating = F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.format_string("%.2f", "value"))
    item = F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("event_id").cast("string"))
    return events.select(F.concat_ws("::", F.col("user_id").cast("string"), item, rating, date).alias("value"))


def rating_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """How many event lines are no ratings, and why."""
    parsed = rating_ops.parse_ratings(_event_lines(spark, folder))
    return parsed.groupBy("reject_reason").agg(F.count("*").alias("n_lines"))


def rating_reject_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The event lines that are no ratings, each with its reason."""
    return rejects.rejected(rating_ops.parse_ratings(_event_lines(spark, folder))).select("value", "reject_reason")


def rating_validate(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.validate_stars(fixtures.typed_stars(spark, folder)).select(
        "event_id", "raw", "stars", "reject_reason")


def rating_cap(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col("rated_at"), F.col("item_id"), F.col("rating")]
    capped = rating_ops.cap_per_user(fixtures.ratings(spark, folder), order)
    return capped.select("user_id", "item_id", "rating", "rated_at", "position")


def rating_cap_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a stream of rating files, several batches of them, by state per user."""
    run = run_folder(spark, "caps")
    columns = ["user_id", "item_id", "rating", "rated_at"]
    ratings = fixtures.ratings(spark, folder).select(*columns)
    ratings.repartition(6).write.parquet(f"{run}/ratings")
    stream = request_stream.request_files(spark, f"{run}/ratings", ratings.schema, files_per_batch=3)
    caps.write_first_ratings(stream, f"{run}/out", f"{run}/progress").awaitTermination()
    return caps.current_lists(spark, f"{run}/out").select(*columns, "position")


def store_dim(spark: SparkSession, folder: str) -> DataFrame:
    return stores.distinct_stores(rejects.accepted(stores.parse_stores(fixtures.store_lines(spark, folder))))


def url_params(spark: SparkSession, folder: str) -> DataFrame:
    return requests.url_params(fixtures.table(spark, folder, "pages").select("page_id", "url"))


def request_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return requests.request_ratings(fixtures.line_requests(spark, folder))


def bucket_split(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.split_sizes(fixtures.ratings(spark, folder))


def ratings_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.summary(fixtures.ratings(spark, folder))


def ratings_by_slice(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.summary(fixtures.sliced_ratings(spark, folder), ("season", "state"))


def distinct_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings, users and items per slice, per season and in all, each level from the bitmaps of the one below."""
    slices = cut_lineage(distincts.id_bitmaps(fixtures.sliced_ratings(spark, folder), ["season", "state"]))
    seasons = cut_lineage(distincts.merged(slices, ["season"]))
    none = F.lit(None).cast("string")
    levels = (distincts.distinct_counts(slices, ["season", "state"]),
              distincts.distinct_counts(seasons, ["season"]).withColumn("state", none),
              distincts.distinct_counts(distincts.merged(seasons, []), []).withColumns({"season": none, "state": none}))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def rating_cap_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """The cap and each user's state from tables laid out by user; neither shuffles ratings again."""
    run, name = run_folder(spark, "by-user"), uuid.uuid4().hex
    write_by_user(fixtures.ratings(spark, folder), f"ratings_{name}", f"{run}/ratings", 8, order=("rated_at", "item_id", "rating"))
    write_by_user(fixtures.users(spark, folder), f"users_{name}", f"{run}/users", 8)
    capped = rating_ops.cap_per_user(read_by_user(spark, f"ratings_{name}"), [F.col("rated_at"), F.col("item_id"), F.col("rating")])
    return capped.join(read_by_user(spark, f"users_{name}").hint("merge"), "user_id").select(
        "user_id", "item_id", "rating", "rated_at", "position", "state")


def baseline_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Split sizes and the mean baseline from tallies per file, updated as files come: two loads and a replay."""
    run = run_folder(spark, "tallies")
    ratings = fixtures.ratings(spark, folder).select("user_id", "item_id", "rating", "bucket")
    for early in (True, False):
        ratings.filter((F.col("user_id") % 3 == 0) == early).write.mode("append").parquet(f"{run}/ratings")
        tallies.update(spark, f"{run}/ratings", f"{run}/state")
    tallies.update(spark, f"{run}/ratings", f"{run}/state")
    return tallies.mean_baseline(tallies.tallies(spark, f"{run}/state")).select(
        "n_train", "n_validation", "n_test", F.round("mean_rating", 6).alias("mean_rating"),
        F.round("baseline_rmse", 6).alias("baseline_rmse"))


def stored_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary over a stored table of ratings, which the second use reads instead of joining anew."""
    tables = stored.StoredTables(spark, run_folder(spark, "stored"))
    inputs = [f"{folder}/{name}.parquet" for name in ("lineitem", "orders")]

    def build(session: SparkSession, *_paths: str) -> DataFrame:
        return fixtures.ratings(session, folder)

    tables.get("ratings", build, inputs)
    return rating_ops.summary(tables.get("ratings", build, inputs))


def season_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rating_ops.season_counts(fixtures.table(spark, folder, "orders"), "o_orderdate")


def training_union(spark: SparkSession, folder: str) -> DataFrame:
    """The training set: the ratings and those of all slice requests."""
    asked = rejects.accepted(requests.request_ratings(fixtures.slice_requests(spark, folder)))
    return candidates.training_union(fixtures.ratings(spark, folder), asked)


def unrated_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every store each slice request has not rated."""
    asked = cut_lineage(rejects.accepted(requests.request_ratings(fixtures.slice_requests(spark, folder))))
    return candidates.unrated(fixtures.stores(spark, folder), asked, asked).select("user_id", "item_id")


def factor_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all rated (user, item) pairs whose ids both have a factor row."""
    pairs = fixtures.ratings(spark, folder).select("user_id", "item_id").distinct()
    vectors = fixtures.factors(spark, folder)
    scores = ranking.factor_scores(pairs, vectors, vectors)
    return scores.select("user_id", "item_id", F.round("score", 4).alias("score"))


def topn_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_per_user(factor_score(spark, folder)).select("user_id", "rank", "item_id", "score")


def topn_with_names(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best-rated stores overall among those with a name."""
    listed = fixtures.stores(spark, folder)
    means = fixtures.ratings(spark, folder).groupBy("item_id").agg(F.avg("rating").alias("score"))
    top = ranking.top_overall(ranking.only_listed(means, listed))
    return ranking.with_names(top, listed).select("item_id", "name", "address", F.round("score", 6).alias("score"))


def positional_pair(spark: SparkSession, folder: str) -> DataFrame:
    part = fixtures.table(spark, folder, "part").select("p_partkey", "p_name")
    supplier = fixtures.table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return ranking.pair_by_position(part, supplier, ["p_name", "p_partkey"], ["s_suppkey"])


def _results(spark: SparkSession, folder: str) -> DataFrame:
    part = fixtures.table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("address"),
        F.col("p_retailprice").alias("score"))
    return ranking.format_results(part).select("item_id", "result")


def result_format(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder)


def result_split(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.split_results(_results(spark, folder))


def rmse_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Error of the item-mean model, trained on the train split, on the test split."""
    split = cut_lineage(rating_ops.with_split(fixtures.ratings(spark, folder)).select("user_id", "item_id", "rating", "split"))
    test = split.filter(F.col("split") == "test").select("user_id", "item_id", "rating")
    means = evaluation.item_means(split.filter(F.col("split") == "train"))
    pairs = test.select("user_id", "item_id").distinct()
    predictions = skew.salted_join(pairs, means, "item_id", "user_id")
    error = evaluation.joined_rmse(test, predictions)
    return error.select("n_scored", "n_all", F.round("rmse_scored", 6).alias("rmse_scored"),
                        F.round("rmse_all", 6).alias("rmse_all"))


def baseline_rmse(spark: SparkSession, folder: str) -> DataFrame:
    split = rating_ops.with_split(fixtures.ratings(spark, folder))
    compared = evaluation.item_mean_against_baseline(split)
    return compared.select("n_test", *[
        F.round(name, 6).alias(name) for name in ("mean_rating", "baseline_rmse", "test_rmse", "improvement_pct")])


def wc_top_words(spark: SparkSession, folder: str) -> DataFrame:
    return words.by_count(words.count_words(fixtures.table(spark, folder, "documents"), "text"))


def wc_prefix_top(spark: SparkSession, folder: str) -> DataFrame:
    return words.top_with_letter(words.count_words(fixtures.table(spark, folder, "documents"), "text"), "a")


def range_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the order keys of all order lines."""
    total = sums.column_sum(fixtures.table(spark, folder, "lineitem"), "l_orderkey")
    return total.select(F.col("total").cast("string").alias("total"))


def top_items_per_group(spark: SparkSession, folder: str) -> DataFrame:
    top = toplists.top_items(fixtures.sliced_ratings(spark, folder))
    return top.select("state", "season", "rank", "item_id", "n_ratings", F.round("mean_rating", 6).alias("mean_rating"))


def dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    part = fixtures.table(spark, folder, "part")
    return ids.dense_ids(part.select(F.concat_ws("/", "p_brand", "p_name").alias("store_key")), "store_key")


def item_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.similar_items(fixtures.ratings(spark, folder), digits=6).select(
        "item_id", "rank", "similar_id", "similarity", "support")


def item_similarity_busy_users(spark: SparkSession, folder: str) -> DataFrame:
    """The same with users of more than twenty ratings taken as heavy ones."""
    return similarity.similar_items(fixtures.ratings(spark, folder), heavy=20, digits=6).select(
        "item_id", "rank", "similar_id", "similarity", "support")


def als_recommend(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty recommendations for the request of each state and season, from the ratings of that slice."""
    asked = rejects.accepted(requests.request_ratings(fixtures.slice_requests(spark, folder)))
    listed = stores.one_text_per_store(fixtures.stores(spark, folder))
    best = als.recommend_for_requests(fixtures.sliced_ratings(spark, folder), asked, listed)
    return best.withColumn("score", F.round("score", 4))


def als_recommend_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for the recommendations of each request, whatever the model: see the SQL form."""
    asked = cut_lineage(rejects.accepted(requests.request_ratings(fixtures.slice_requests(spark, folder))))
    listed = stores.one_text_per_store(fixtures.stores(spark, folder))
    sliced = cut_lineage(fixtures.sliced_ratings(spark, folder).select("user_id", "item_id", "rating", "season", "state"))
    best = als.recommend_for_requests(sliced, asked, listed)
    slices = asked.select("request_id", "season", "state").distinct()
    known = sliced.select("season", "state", "item_id").distinct().withColumn("in_slice", F.lit(1))
    rated = asked.select("request_id", "item_id").distinct().withColumn("is_rated", F.lit(1))
    return best.join(slices, "request_id").join(known, ["season", "state", "item_id"], "left").join(
        rated, ["request_id", "item_id"], "left").groupBy("request_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("rank").alias("n_ranks"), F.max("rank").cast("bigint").alias("last_rank"),
        F.count("in_slice").alias("n_in_slice"), F.count("is_rated").alias("n_rated"))


def als_grid(spark: SparkSession, folder: str) -> DataFrame:
    return als.grid_search(fixtures.ratings(spark, folder))


def _whole_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.ratings(spark, folder).select(F.lit("").alias("slice"), "user_id", "item_id", "rating")


def fold_in_users(spark: SparkSession, folder: str) -> DataFrame:
    """Factors of every customer from its own ratings and fixed item vectors, one row per number."""
    users = foldin.fold_in(_whole_ratings(spark, folder), fixtures.item_vectors(spark, folder), als.AlsSettings().reg)
    return users.select("user_id", "n_known", F.posexplode("features").alias("place", "value")).withColumn(
        "value", F.round("value", 6) + 0.0)


def fold_in_top(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best unrated items of every customer by its folded-in factors."""
    rated = set_down(_whole_ratings(spark, folder), "ratings")
    items = set_down(fixtures.item_vectors(spark, folder), "items")
    users = foldin.fold_in(rated, items, als.AlsSettings().reg)
    # dealt by user once: neither the distinct rows nor the users' lists of them are dealt again
    taken = rated.select("slice", "user_id", "item_id").repartition("slice", "user_id").distinct()
    best = topk.best_unrated(users, topk.item_blocks(items), taken, 20)
    return ranking.top_per_user(best).select("user_id", "rank", "item_id", F.round("score", 4).alias("score"))


def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Requests, one per order with all its lines, as a file stream scored from a published model."""
    run = run_folder(spark, "scores")
    listed = stores.one_text_per_store(fixtures.stores(spark, folder))
    serving.publish(fixtures.item_vectors(spark, folder), listed, als.AlsSettings().reg, f"{run}/models")
    fixtures.line_requests(spark, folder).write.parquet(f"{run}/requests")
    query = request_stream.score_from_store(
        request_stream.request_files(spark, f"{run}/requests"), f"{run}/models", listed, f"{run}/out", f"{run}/progress", by=())
    query.awaitTermination()
    return read_table(spark, f"{run}/out").select("request_id", "rank", "item_id", "name", F.round("score", 4).alias("score"))


def als_served_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold when the slice requests are answered from a trained and published model, whatever the model.

    Each score is held against the item's factor row and the factors that solve the request's own equations.
    """
    run = run_folder(spark, "served")
    asked = cut_lineage(rejects.accepted(requests.request_ratings(fixtures.slice_requests(spark, folder))))
    listed = stores.one_text_per_store(fixtures.stores(spark, folder))
    serving.train_and_publish(fixtures.sliced_ratings(spark, folder), listed, f"{run}/models")
    model = serving.load(spark, f"{run}/models")
    best = cut_lineage(serving.answer(model, asked, listed))
    cut = als.slice_of(("season", "state"))
    users = foldin.fold_in(asked.select(cut, "user_id", "item_id", "rating"), model.items, model.reg).select(
        "slice", (-F.col("user_id")).alias("request_id"), F.col("features").alias("_user"), "n_known")
    rated = asked.select("request_id", "item_id").distinct().withColumn("is_rated", F.lit(1))
    met = best.join(users, "request_id").join(model.items, ["slice", "item_id"]).join(rated, ["request_id", "item_id"], "left")
    right = F.abs(F.col("score") - numbers.dot(F.col("_user"), F.col("features"))) < 1e-6
    return met.groupBy("request_id", "n_known").agg(
        F.count("*").alias("n_rows"), F.max("rank").cast("bigint").alias("last_rank"),
        F.count("is_rated").alias("n_rated"), F.count_if(right).alias("n_right"))


def als_grid_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for the grid search, whatever the models: sizes, one best setting, its improvement on the baseline."""
    grid = cut_lineage(als.grid_search(fixtures.ratings(spark, folder)))
    best = F.col("is_best")
    error = F.max(F.when(best, F.col("rmse_all")))
    gain = numbers.percent_improvement(F.max("baseline_rmse"), F.max("test_rmse"))
    return grid.agg(
        F.count("*").alias("n_rows"), F.count_distinct("rank", "reg", "iterations").alias("n_settings"),
        F.count_if(best).alias("n_best"), F.count("test_rmse").alias("n_tested"), F.count("rmse_scored").alias("n_scored"),
        (error == F.min("rmse_all")).alias("best_is_least"),
        (F.abs(gain - F.max("improvement_pct")) < 1e-9).alias("gain_fits"),
        F.round(F.max("baseline_rmse"), 6).alias("baseline_rmse"))


def kept_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Two uses of one kept set of ratings, spread over partitions; released before the result is read."""
    def build(session: SparkSession, path: str) -> DataFrame:
        return datasets.keep(datasets.spread(fixtures.ratings(session, path), 16, "user_id"))

    with datasets.Datasets() as shared:
        whole = cut_lineage(rating_ops.summary(shared.get(build, spark, folder)))
        most = shared.get(build, spark, folder).groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return whole.withColumn("most_of_a_user", F.lit(most).cast("bigint"))


def toplist_load(spark: SparkSession, folder: str) -> DataFrame:
    """The load job end to end: packed lines as text files, parsed into the store table, read back."""
    run = run_folder(spark, "toplist")
    write_lines(toplists.pack_top_lines(fixtures.top_stores(spark, folder)), f"{run}/lines")
    load_top_stores(spark, f"{run}/lines", f"{run}/stores")
    return read_table(spark, f"{run}/stores")


def toplist_load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What the load job refuses: winter's states are unknown, spring's lines end early, summer's stores have no names."""
    run = run_folder(spark, "toplist")
    top = cut_lineage(fixtures.top_stores(spark, folder))
    state = F.when(F.col("season") == "winter", F.concat(F.lit("X"), "state")).otherwise(F.col("state"))
    lines = toplists.pack_top_lines(top.withColumn("state", state).withColumn(
        "name", F.when(F.col("season") != "summer", F.col("name"))))
    cut = F.when(F.col("value").contains("::spring::"), F.substring_index("value", "::", 2)).otherwise(F.col("value"))
    write_lines(lines.select(cut.alias("value")), f"{run}/lines")
    load_top_stores(spark, f"{run}/lines", f"{run}/stores", f"{run}/rejects")
    return read_table(spark, f"{run}/rejects").select("value", "rank", "reject_reason")


def ratings_load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What the load of the event lines refuses, with lines of unknown users."""
    run = run_folder(spark, "ratings")
    write_lines(_event_lines(spark, folder), f"{run}/lines")
    load_ratings(spark, f"{run}/lines", fixtures.users(spark, folder), f"{run}/slices", f"{run}/rejects")
    return read_table(spark, f"{run}/rejects")


def ratings_load(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings as text files, loaded into the table by season and state, and read back."""
    run = run_folder(spark, "ratings")
    write_lines(rating_ops.rating_lines(fixtures.ratings(spark, folder)), f"{run}/lines")
    load_ratings(spark, f"{run}/lines", fixtures.users(spark, folder), f"{run}/slices")
    return read_table(spark, f"{run}/slices").select("user_id", "item_id", "rating", "bucket", "season", "state")


def ratings_of_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings of one season and state, read from the layout by slice: the training input of one request."""
    return read_slice(spark, _slices(spark, folder), "winter", "NV").select("user_id", "item_id", "rating")


def ratings_of_season(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings of one season, read from the layout by slice."""
    return read_slice(spark, _slices(spark, folder), "winter").select("user_id", "item_id", "rating", "state")


def _slices(spark: SparkSession, folder: str) -> str:
    run = run_folder(spark, "slices")
    write_slices(fixtures.sliced_ratings(spark, folder).select("user_id", "item_id", "rating", "season", "state"), run)
    return run


def stream_requests(spark: SparkSession, folder: str) -> DataFrame:
    """``url_params`` run as a file stream over the pages."""
    run = run_folder(spark, "requests")
    # The stream source takes a folder or a pattern; the pattern fits the table as one file or as a folder.
    pages = request_stream.request_files(
        spark, f"{folder}/[p]ages.parquet", fixtures.table(spark, folder, "pages").schema)
    query = request_stream.write_batches(
        pages.select("page_id", "url"), requests.url_params, f"{run}/out", f"{run}/progress")
    query.awaitTermination()
    return read_table(spark, f"{run}/out").drop("batch_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        toplist_pack, toplist_parse, toplist_lookup, store_list, state_city_map, ascii_strip, rating_lines,
        rating_parse, rating_rejects, rating_validate, rating_cap, store_dim, url_params, request_ratings,
        bucket_split, ratings_summary, ratings_by_slice, season_counts, training_union, unrated_candidates,
        factor_score, topn_per_user, topn_with_names, positional_pair, result_format, result_split, rmse_eval,
        baseline_rmse, wc_top_words, wc_prefix_top, range_sum, top_items_per_group, dense_ids, item_similarity,
        item_similarity_busy_users,
        fold_in_users, fold_in_top, stream_scores, als_served_rows,
        distinct_rollup, rating_cap_by_user, rating_cap_stream, baseline_kept, stored_summary, toplist_lookup_files, rating_reject_rows,
        toplist_load_rejects, ratings_load_rejects,
        als_recommend, als_recommend_rows, als_grid, als_grid_rows, kept_summary, stream_requests, toplist_load, ratings_load, ratings_of_slice, ratings_of_season,
    )
}
