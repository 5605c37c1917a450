"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from starpath.schemas import CITIES

_CITIES = ", ".join(f"({index}, '{state}', '{city}')" for index, (state, city) in enumerate(CITIES))

_PLACES = f"places AS (SELECT * FROM (VALUES {_CITIES}) AS v(state_index, state, city))"

_RATINGS = """ratings AS (
    SELECT o_orderkey, o_custkey AS user_id, l_partkey AS item_id, l_suppkey, l_linenumber,
           CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
           strftime(o_orderdate, '%Y-%m-%d') AS rated_at,
           CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 10, 1) AS INTEGER) AS bucket,
           CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring'
                WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer'
                WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_SPLIT = """split_ratings AS (
    SELECT *, CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 THEN 'validation' ELSE 'test' END AS split
    FROM ratings)"""

_SLICED = """sliced AS (
    SELECT r.*, state_index, state, city
    FROM ratings r JOIN customer ON user_id = c_custkey JOIN places ON state_index = c_nationkey % 10)"""

_TOP = """top AS (
    SELECT * FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY state, season
                                          ORDER BY n_ratings DESC, mean_rating DESC, item_id) AS INTEGER) AS rank
        FROM (SELECT state_index, state, city, season, item_id, count(*) AS n_ratings, avg(rating) AS mean_rating
              FROM sliced GROUP BY ALL))
    WHERE rank <= 50),
named AS (SELECT top.*, p_name AS name FROM top JOIN part ON item_id = p_partkey)"""

_TOP_LISTS = f"WITH {_PLACES}, {_RATINGS}, {_SLICED}, {_TOP}"

_PACKED = """packed AS (
    SELECT state, season, string_agg(item_id || ',' || name, '|' ORDER BY rank) AS stores,
           string_agg(item_id || ',' || name, '|' ORDER BY rank) FILTER (WHERE rank <= 10) AS first_stores
    FROM named GROUP BY state, season)"""

_ASKED = """asked AS (
    SELECT -(state_index * 4 + list_position(['spring', 'summer', 'autumn', 'winter'], season)) AS user_id,
           item_id, floor(mean_rating + 0.5) AS rating
    FROM top WHERE rank <= 10)"""

_SCORES = """scores AS (
    SELECT user_id, item_id,
           round(list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 4) AS score
    FROM (SELECT DISTINCT user_id, item_id FROM ratings)
    JOIN embeddings u ON user_id = u.vec_id JOIN embeddings i ON item_id = i.vec_id)"""

_VECTORS = """vectors AS (
    SELECT item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * mean) AS v
    FROM embeddings JOIN (SELECT item_id, avg(rating) AS mean FROM ratings GROUP BY item_id) ON vec_id = item_id)"""

# A user's factors as a weighted sum of its items' vectors. The weights solve (V V' + reg n I) w = r, which is as
# many equations as the user has known ratings; they are eliminated one after the other.
_FOLDED = """known AS (
    SELECT user_id, item_id, rating, v, row_number() OVER (PARTITION BY user_id ORDER BY item_id, rating) AS k,
           count(*) OVER (PARTITION BY user_id) AS n
    FROM given JOIN vectors USING (item_id)),
equations AS (
    SELECT a.user_id, a.n, a.k,
           list_append(list(list_dot_product(a.v, b.v) + CASE WHEN a.k = b.k THEN 0.4 * a.n ELSE 0 END ORDER BY b.k),
                       any_value(a.rating)) AS line
    FROM known a JOIN known b ON a.user_id = b.user_id GROUP BY a.user_id, a.n, a.k),
solved(step, user_id, n, m) AS (
    SELECT 0, user_id, n, list(line ORDER BY k) FROM equations GROUP BY user_id, n
    UNION ALL
    SELECT step + 1, user_id, n, list_transform(m, lambda line, i:
               CASE WHEN i = step + 1 THEN list_transform(line, lambda x: x / line[step + 1])
                    ELSE list_transform(line, lambda x, j: x - line[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
    FROM solved WHERE step < n),
weights AS (
    SELECT user_id, n, unnest(list_transform(m, lambda line: line[n + 1])) AS w, unnest(range(1, n + 1)) AS k
    FROM solved WHERE step = n),
numbers AS (
    SELECT user_id, n, place, sum(w * v[place + 1]) AS x
    FROM weights JOIN known USING (user_id, n, k) CROSS JOIN range(64) AS places(place) GROUP BY user_id, n, place),
folded AS (SELECT user_id, n, list(x ORDER BY place) AS x FROM numbers GROUP BY user_id, n),
listed AS (
    SELECT user_id, item_id, list_dot_product(x, v) AS score,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY list_dot_product(x, v) DESC, item_id) AS INTEGER) AS rank
    FROM folded CROSS JOIN vectors
    WHERE NOT EXISTS (SELECT 1 FROM given WHERE given.user_id = folded.user_id AND given.item_id = vectors.item_id)
    QUALIFY rank <= 20)"""

_EVENT_LINES = """WITH lines AS (
    SELECT user_id, CASE event_type WHEN 'signup' THEN 'bad_id' WHEN 'error' THEN 'bad_rating'
                                    WHEN 'view' THEN 'bad_date' END AS reject_reason,
           concat_ws('::', CAST(user_id AS VARCHAR), CASE WHEN event_type = 'signup' THEN '' ELSE CAST(event_id AS VARCHAR) END,
                     CASE WHEN event_type = 'error' THEN 'none' ELSE printf('%.2f', value) END,
                     CASE WHEN event_type = 'view' THEN '2024-01' ELSE strftime(ts, '%Y-%m-%d') END) AS value
    FROM events)"""

_WORDS = r"""words AS (
    SELECT word, count(*) AS cnt
    FROM (SELECT unnest(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word)"""

_URL_PARAMS = """
    SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, split_part(pair, '=', 1) AS key, split_part(pair, '=', 2) AS value
    FROM (SELECT page_id, unnest(string_split(query, '&')) AS pair,
                 generate_subscripts(string_split(query, '&'), 1) AS pos
          FROM (SELECT page_id, split_part(url, '?', 2) AS query FROM pages WHERE contains(url, '?')))"""

_RESULT = "printf('%s::%s::%.2f', p_name, p_brand, p_retailprice)"

CHECKS: dict[str, str] = {
    "toplist_pack": f"{_TOP_LISTS}, {_PACKED} SELECT concat_ws('::', state, season, stores) AS value FROM packed",
    "toplist_parse": f"""{_TOP_LISTS}
        SELECT city, season, CAST(item_id AS VARCHAR) AS store_id, name AS store_name, rank FROM named""",
    "toplist_lookup": f"""{_TOP_LISTS}, {_PACKED}
        SELECT state, season, arg_max(stores, line_order) AS stores
        FROM (SELECT state, season, stores, 1 AS line_order FROM packed
              UNION ALL
              SELECT state, season, first_stores, 2 FROM packed WHERE season <> 'winter')
        GROUP BY state, season""",
    "store_list": f"""{_TOP_LISTS}
        SELECT rank, item_id AS store_id, name, season, city FROM named
        WHERE season = 'winter' AND city = 'Las Vegas' ORDER BY rank, item_id LIMIT 10""",
    "state_city_map": f"""WITH {_PLACES}
        SELECT state AS from_state, city, state, count(*) AS n_customers
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN places ON state_index = n_nationkey % 10
        GROUP BY state, city""",
    "ascii_strip": r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS plain FROM documents",
    "rating_lines": f"""WITH {_RATINGS}
        SELECT concat_ws('::', user_id, item_id, CAST(rating AS INTEGER), rated_at) AS value FROM ratings""",
    "rating_parse": f"WITH {_RATINGS} SELECT user_id, item_id, rating, rated_at, bucket FROM ratings",
    "rating_rejects": """
        SELECT CASE event_type WHEN 'signup' THEN 'bad_id' WHEN 'error' THEN 'bad_rating'
                               WHEN 'view' THEN 'bad_date' END AS reject_reason,
               count(*) AS n_lines
        FROM events GROUP BY 1""",
    "rating_reject_rows": f"""{_EVENT_LINES}
        SELECT value, reject_reason FROM lines WHERE reject_reason IS NOT NULL""",
    "ratings_load_rejects": f"""{_EVENT_LINES}
        SELECT value, coalesce(reject_reason, 'unknown_user') AS reject_reason
        FROM lines WHERE reject_reason IS NOT NULL OR user_id NOT IN (SELECT c_custkey FROM customer)""",
    "toplist_load_rejects": f"""{_TOP_LISTS},
        packed AS (
            SELECT season, CASE WHEN season = 'winter' THEN 'X' ELSE '' END || state || '::' || season
                   || CASE WHEN season = 'spring' THEN '' ELSE '::' || string_agg(
                          CASE WHEN season = 'summer' THEN CAST(item_id AS VARCHAR) ELSE item_id || ',' || name END, '|' ORDER BY rank) END AS value,
                   count(*) AS n
            FROM named GROUP BY state, season)
        SELECT value, CAST(rank AS INTEGER) AS rank,
               CASE season WHEN 'winter' THEN 'unknown_state' ELSE 'missing_name' END AS reject_reason
        FROM packed, range(1, 51) AS places(rank) WHERE rank <= n AND season IN ('winter', 'summer')
        UNION ALL
        SELECT value, NULL, 'missing_field' FROM packed WHERE season = 'spring'""",
    "rating_validate": """
        WITH typed AS (
            SELECT event_id,
                   CASE WHEN event_type IN ('click', 'view') THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                        WHEN event_type = 'signup' THEN CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)
                        ELSE printf('%.2f', value) END AS raw
            FROM events),
        judged AS (
            SELECT event_id, raw,
                   CASE WHEN contains(raw, '.') THEN 'not_a_number'
                        WHEN CAST(raw AS BIGINT) = 0 THEN 'not_visited'
                        WHEN CAST(raw AS BIGINT) > 5 THEN 'out_of_range' END AS reject_reason
            FROM typed)
        SELECT event_id, raw, CASE WHEN reject_reason IS NULL THEN TRY_CAST(raw AS INTEGER) END AS stars,
               reject_reason
        FROM judged""",
    "rating_cap": f"""WITH {_RATINGS}
        SELECT * FROM (
            SELECT user_id, item_id, rating, rated_at,
                   CAST(row_number() OVER (PARTITION BY user_id ORDER BY rated_at, item_id, rating) AS INTEGER)
                       AS position
            FROM ratings)
        WHERE position <= 11""",
    "store_dim": "SELECT DISTINCT p_partkey AS item_id, p_name AS name, p_brand AS address FROM part",
    "url_params": _URL_PARAMS,
    "request_ratings": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT o_orderkey + 1 AS request_id, season, city, state, -(o_orderkey + 1) AS user_id,
               item_id, rating, CAST(NULL AS VARCHAR) AS reject_reason
        FROM sliced
        UNION ALL
        SELECT o_orderkey + 1, season, city, state, -(o_orderkey + 1), l_suppkey,
               CASE WHEN l_linenumber <= 5 THEN CAST(l_linenumber AS DOUBLE) END,
               CASE WHEN l_linenumber > 5 THEN 'out_of_range' END
        FROM sliced""",
    "bucket_split": f"WITH {_RATINGS}, {_SPLIT} SELECT split, count(*) AS n_ratings FROM split_ratings GROUP BY split",
    "ratings_summary": f"""WITH {_RATINGS}
        SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items
        FROM ratings""",
    "ratings_by_slice": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT season, state, count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
               count(DISTINCT item_id) AS n_items
        FROM sliced GROUP BY season, state""",
    "kept_summary": f"""WITH {_RATINGS}
        SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id)) AS most_of_a_user
        FROM ratings""",
    "als_grid_rows": f"""WITH {_RATINGS}, {_SPLIT},
        overall AS (SELECT avg(rating) AS mean_rating FROM split_ratings WHERE split <> 'test')
        SELECT CAST(8 AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_settings, CAST(1 AS BIGINT) AS n_best, CAST(1 AS BIGINT) AS n_tested,
               CAST(8 AS BIGINT) AS n_scored, TRUE AS best_is_least, TRUE AS gain_fits,
               round(sqrt(avg((mean_rating - rating) ** 2)), 6) AS baseline_rmse
        FROM split_ratings CROSS JOIN overall WHERE split = 'test'""",
    "distinct_rollup": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT season, state, count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id, count(DISTINCT item_id) AS n_item_id
        FROM sliced GROUP BY GROUPING SETS ((season, state), (season), ())""",
    "rating_cap_by_user": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT * FROM (
            SELECT user_id, item_id, rating, rated_at,
                   CAST(row_number() OVER (PARTITION BY user_id ORDER BY rated_at, item_id, rating) AS INTEGER) AS position, state
            FROM sliced)
        WHERE position <= 11""",
    "baseline_kept": f"""WITH {_RATINGS}, {_SPLIT},
        overall AS (SELECT avg(rating) AS mean_rating FROM split_ratings WHERE split <> 'test')
        SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
               count(*) FILTER (WHERE split = 'test') AS n_test, round(any_value(mean_rating), 6) AS mean_rating,
               round(sqrt(avg((mean_rating - rating) ** 2) FILTER (WHERE split = 'test')), 6) AS baseline_rmse
        FROM split_ratings CROSS JOIN overall""",
    "season_counts": """
        SELECT CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring'
                    WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer'
                    WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season,
               count(*) AS n_ratings
        FROM orders GROUP BY 1""",
    "training_union": f"""{_TOP_LISTS}, {_ASKED}
        SELECT user_id, item_id, rating FROM ratings
        UNION ALL SELECT CAST(user_id AS BIGINT), item_id, CAST(rating AS DOUBLE) FROM asked""",
    "unrated_candidates": f"""{_TOP_LISTS}, {_ASKED}
        SELECT CAST(user_id AS BIGINT) AS user_id, p_partkey AS item_id
        FROM (SELECT DISTINCT user_id FROM asked) users CROSS JOIN part
        WHERE NOT EXISTS (SELECT 1 FROM asked WHERE asked.user_id = users.user_id AND asked.item_id = p_partkey)""",
    "als_recommend_rows": f"""{_TOP_LISTS}, {_ASKED},
        requests AS (
            SELECT DISTINCT state_index * 4 + list_position(['spring', 'summer', 'autumn', 'winter'], season) AS request_id,
                   season, state
            FROM top WHERE rank <= 10),
        open_pairs AS (
            SELECT DISTINCT request_id, sliced.item_id
            FROM requests JOIN sliced USING (season, state) JOIN part ON sliced.item_id = p_partkey
            WHERE NOT EXISTS (SELECT 1 FROM asked WHERE asked.user_id = -request_id AND asked.item_id = sliced.item_id))
        SELECT CAST(request_id AS BIGINT) AS request_id, least(count(*), 20) AS n_rows, least(count(*), 20) AS n_ranks,
               least(count(*), 20) AS last_rank, least(count(*), 20) AS n_in_slice, CAST(0 AS BIGINT) AS n_rated
        FROM open_pairs GROUP BY request_id""",
    "als_served_rows": f"""{_TOP_LISTS}, {_ASKED},
        requests AS (
            SELECT state_index * 4 + list_position(['spring', 'summer', 'autumn', 'winter'], season) AS request_id,
                   season, state, count(*) AS n_known
            FROM top WHERE rank <= 10 GROUP BY ALL),
        open_pairs AS (
            SELECT DISTINCT request_id, n_known, sliced.item_id
            FROM requests JOIN sliced USING (season, state) JOIN part ON sliced.item_id = p_partkey
            WHERE NOT EXISTS (SELECT 1 FROM asked WHERE asked.user_id = -request_id AND asked.item_id = sliced.item_id))
        SELECT CAST(request_id AS BIGINT) AS request_id, n_known, least(count(*), 20) AS n_rows,
               least(count(*), 20) AS last_rank, CAST(0 AS BIGINT) AS n_rated, least(count(*), 20) AS n_right
        FROM open_pairs GROUP BY request_id, n_known""",
    "fold_in_users": f"""WITH RECURSIVE {_RATINGS}, {_VECTORS}, given AS (SELECT user_id, item_id, rating FROM ratings), {_FOLDED}
        SELECT user_id, n AS n_known, CAST(place AS INTEGER) AS place, round(x, 6) + 0.0 AS value FROM numbers""",
    "fold_in_top": f"""WITH RECURSIVE {_RATINGS}, {_VECTORS}, given AS (SELECT user_id, item_id, rating FROM ratings), {_FOLDED}
        SELECT user_id, rank, item_id, round(score, 4) AS score FROM listed""",
    "stream_scores": f"""WITH RECURSIVE {_RATINGS}, {_VECTORS},
        given AS (
            SELECT -(o_orderkey + 1) AS user_id, item_id, rating FROM ratings
            UNION ALL
            SELECT -(o_orderkey + 1), l_suppkey, CAST(l_linenumber AS DOUBLE) FROM ratings WHERE l_linenumber BETWEEN 1 AND 5),
        {_FOLDED}
        SELECT -user_id AS request_id, rank, item_id, p_name AS name, round(score, 4) AS score
        FROM listed JOIN part ON item_id = p_partkey""",
    "factor_score": f"WITH {_RATINGS}, {_SCORES} SELECT user_id, item_id, score FROM scores",
    "topn_per_user": f"""WITH {_RATINGS}, {_SCORES}
        SELECT * FROM (
            SELECT user_id,
                   CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank,
                   item_id, score
            FROM scores)
        WHERE rank <= 20""",
    "topn_with_names": f"""WITH {_RATINGS}
        SELECT item_id, p_name AS name, p_brand AS address, round(score, 6) AS score
        FROM (SELECT item_id, avg(rating) AS score FROM ratings
              WHERE item_id IN (SELECT p_partkey FROM part)
              GROUP BY item_id ORDER BY score DESC, item_id LIMIT 20)
        JOIN part ON item_id = p_partkey""",
    "positional_pair": """
        SELECT position, p_partkey, p_name, s_suppkey, s_name
        FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS position FROM part)
        JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier)
        USING (position)""",
    "result_format": f"SELECT p_partkey AS item_id, {_RESULT} AS result FROM part",
    "result_split": f"""
        SELECT item_id, split_part(result, '::', 1) AS label, CAST(pos - 1 AS INTEGER) AS pos, token
        FROM (SELECT item_id, result, unnest(string_split(result, '::')) AS token,
                     generate_subscripts(string_split(result, '::'), 1) AS pos
              FROM (SELECT p_partkey AS item_id, {_RESULT} AS result FROM part))
        WHERE token <> ''""",
    "rmse_eval": f"""WITH {_RATINGS}, {_SPLIT},
        means AS (SELECT item_id, avg(rating) AS prediction FROM split_ratings WHERE split = 'train' GROUP BY item_id)
        SELECT count(prediction) AS n_scored, count(*) AS n_all,
               round(sqrt(sum((prediction - rating) ** 2) / count(prediction)), 6) AS rmse_scored,
               round(sqrt(sum((prediction - rating) ** 2) / count(*)), 6) AS rmse_all
        FROM split_ratings LEFT JOIN means USING (item_id) WHERE split = 'test'""",
    "baseline_rmse": f"""WITH {_RATINGS}, {_SPLIT},
        overall AS (SELECT avg(rating) AS mean_rating FROM split_ratings WHERE split <> 'test'),
        means AS (SELECT item_id, avg(rating) AS prediction FROM split_ratings WHERE split = 'train' GROUP BY item_id),
        errors AS (
            SELECT count(*) AS n_test, any_value(mean_rating) AS mean_rating,
                   sqrt(avg((mean_rating - rating) ** 2)) AS baseline_rmse,
                   sqrt(avg((coalesce(prediction, mean_rating) - rating) ** 2)) AS test_rmse
            FROM split_ratings LEFT JOIN means USING (item_id) CROSS JOIN overall WHERE split = 'test')
        SELECT n_test, round(mean_rating, 6) AS mean_rating, round(baseline_rmse, 6) AS baseline_rmse,
               round(test_rmse, 6) AS test_rmse,
               round((baseline_rmse - test_rmse) / baseline_rmse * 100, 6) AS improvement_pct
        FROM errors""",
    "wc_top_words": f"WITH {_WORDS} SELECT word, cnt FROM words ORDER BY cnt DESC, word",
    "wc_prefix_top": f"""WITH {_WORDS}
        SELECT word, cnt FROM words WHERE lower(substr(word, 1, 1)) = 'a' ORDER BY cnt DESC, word LIMIT 10""",
    "range_sum": "SELECT CAST(coalesce(sum(l_orderkey), 0) AS VARCHAR) AS total FROM lineitem",
    "top_items_per_group": f"""{_TOP_LISTS}
        SELECT state, season, rank, item_id, n_ratings, round(mean_rating, 6) AS mean_rating FROM top""",
    "dense_ids": """
        SELECT store_key, row_number() OVER (ORDER BY md5(store_key), store_key) AS dense_id
        FROM (SELECT DISTINCT p_brand || '/' || p_name AS store_key FROM part)""",
    "item_similarity": f"""WITH {_RATINGS},
        cells AS (SELECT user_id, item_id, avg(rating) AS rating FROM ratings GROUP BY user_id, item_id),
        lengths AS (SELECT item_id, sqrt(sum(rating * rating)) AS length FROM cells GROUP BY item_id),
        sums AS (SELECT a.item_id AS item_id, b.item_id AS similar_id, sum(a.rating * b.rating) AS dot,
                        count(*) AS support
                 FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.item_id <> b.item_id
                 GROUP BY a.item_id, b.item_id HAVING count(*) >= 3),
        cosines AS (SELECT s.item_id, similar_id, round(dot / (x.length * y.length), 6) AS similarity, support
                    FROM sums s JOIN lengths x ON s.item_id = x.item_id JOIN lengths y ON similar_id = y.item_id)
        SELECT * FROM (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, similar_id)
                                 AS INTEGER) AS rank, similar_id, similarity, support
            FROM cosines)
        WHERE rank <= 10""",
    "stream_requests": _URL_PARAMS,
    "toplist_load": f"""{_TOP_LISTS}
        SELECT city, season, CAST(item_id AS VARCHAR) AS store_id, name AS store_name, rank FROM named""",
    "ratings_load": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT user_id, item_id, rating, bucket, season, state FROM sliced""",
    "ratings_of_slice": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT user_id, item_id, rating FROM sliced WHERE season = 'winter' AND state = 'NV'""",
    "ratings_of_season": f"""WITH {_PLACES}, {_RATINGS}, {_SLICED}
        SELECT user_id, item_id, rating, state FROM sliced WHERE season = 'winter'""",
}

CHECKS["item_similarity_busy_users"] = CHECKS["item_similarity"]
CHECKS["stored_summary"] = CHECKS["ratings_summary"]
CHECKS["toplist_lookup_files"] = CHECKS["toplist_lookup"]
CHECKS["rating_cap_stream"] = CHECKS["rating_cap"]
