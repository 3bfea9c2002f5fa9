"""SQL for the registered queries, in DuckDB's dialect over the driver's tables.

Each text says what a query means, not how it is run: the distance join is a plain comparison of
all pairs, a percentile is a count over the whole corpus.
"""

from __future__ import annotations

from vicinage import params as P
from vicinage.plans import fixtures as fx


def _names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(subject: str, bands: tuple, op: str) -> str:
    return " ".join(f"WHEN {subject} {op} {cut} THEN '{text}'" for cut, text in bands if cut is not None)


_LABEL = "CASE bucket " + " ".join(f"WHEN '{b}' THEN '{text}'" for b, text in P.LABELS.items()) + " ELSE replace(bucket, '_', ' ') END"
_NEAR = "CASE " + _case("nearest_m", P.PROXIMITY, "<=") + f" ELSE '{P.PROXIMITY[-1][1]}' END"
_BUCKET = f"""
    CASE WHEN leaf IN ({_names(P.TRANSIT)}) THEN 'transit' WHEN leaf IN ({_names(P.GROCERY)}) THEN 'grocery'
      WHEN g = 'accommodation' THEN 'lodging'
      WHEN g = 'eat_and_drink' THEN CASE sub WHEN 'bar' THEN 'nightlife' WHEN 'cafe' THEN 'cafe' ELSE 'dining' END
      WHEN g = 'retail' THEN 'shopping' WHEN g = 'active_life' THEN 'fitness_sport' WHEN g = 'arts_and_entertainment' THEN 'entertainment'
      WHEN g = 'attractions_and_activities' THEN CASE WHEN sub IN ({_names(P.PARKS)}) THEN 'park_green' WHEN sub IN ({_names(P.CULTURE)}) THEN 'culture' ELSE 'landmark' END
      ELSE g END
"""

#: Letters, marks, digits and joining punctuation, as Unicode has them.
_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}&''’]"
_NAME = f"[A-Z]{_WORD}+(?:[\\s\\x0B\\x85\\p{{Z}}]+[A-Z]{_WORD}+)*"

_BASE = f"""
    taxonomy AS ({fx.TAXONOMY_SQL}),
    dim AS (
        SELECT leaf, {_BUCKET} AS bucket, (g IN ({_names(P.KEPT_GROUPS)}) OR leaf IN ({_names(P.TRANSIT)})) AS allowed
        FROM (SELECT leaf, split_part(path, ',', 1) AS g, CASE WHEN path LIKE '%,%' THEN split_part(path, ',', 2) ELSE path END AS sub FROM taxonomy)
    ),
    listing AS ({fx.LISTINGS_SQL.format(customer="customer")}),
    place AS ({fx.PLACES_SQL.format(orders="orders", taxonomy="taxonomy")}),
    gated AS (SELECT place.*, bucket FROM place JOIN dim ON category = leaf WHERE allowed AND confidence >= 0.6),
    pair AS (
        SELECT l.id, g.poi_id, g.name, g.category, g.bucket, sqrt((l.x_m - g.x_m) * (l.x_m - g.x_m) + (l.y_m - g.y_m) * (l.y_m - g.y_m)) AS dist
        FROM listing l JOIN gated g ON sqrt((l.x_m - g.x_m) * (l.x_m - g.x_m) + (l.y_m - g.y_m) * (l.y_m - g.y_m)) <= 450
    ),
    dense AS (
        SELECT id, bucket, CAST(count(*) FILTER (dist <= 150) AS INTEGER) AS n_doorstep, CAST(count(*) AS INTEGER) AS n_radius, CAST(round_even(min(dist), 0) AS INTEGER) AS nearest_m, min(dist) AS min_dist
        FROM pair GROUP BY id, bucket
    ),
    rectangle AS (
        SELECT n_name AS name, n_nationkey AS ord, (n_nationkey * 2377) % 12000 - w AS x0, (n_nationkey * 5179) % 12000 - w AS y0, (n_nationkey * 2377) % 12000 + w AS x1, (n_nationkey * 5179) % 12000 + w AS y1
        FROM (SELECT n_name, n_nationkey, 50 + 10 * (n_nationkey % 7) AS w FROM nation)
    ),
    edge AS (
        SELECT id, name, ord, sqrt(dx * dx + dy * dy) AS dist
        FROM (SELECT id, name, ord, CAST(greatest(x0 - x_m, 0, x_m - x1) AS DOUBLE) AS dx, CAST(greatest(y0 - y_m, 0, y_m - y1) AS DOUBLE) AS dy FROM listing, rectangle)
    ),
    mark AS (SELECT id, name, ord, CAST(round_even(dist, 0) AS INTEGER) AS dist_m FROM edge WHERE dist <= 800),
    matched AS (SELECT DISTINCT id FROM dense),
    total AS (SELECT count(*) AS n FROM matched),
    full_dense AS (
        SELECT m.id, b.bucket, coalesce(d.n_radius, 0) AS n_radius
        FROM matched m CROSS JOIN (SELECT DISTINCT bucket FROM dense) b LEFT JOIN dense d ON d.id = m.id AND d.bucket = b.bucket
    ),
    hist AS (SELECT bucket, n_radius AS cnt, count(*) AS n FROM full_dense GROUP BY 1, 2),
    zeros AS (SELECT bucket, cnt, n FROM hist UNION ALL SELECT DISTINCT bucket, 0, 0 FROM hist h WHERE NOT EXISTS (SELECT 1 FROM hist z WHERE z.bucket = h.bucket AND z.cnt = 0)),
    ranked AS (
        SELECT bucket, cnt, n, (SELECT coalesce(sum(z.n), 0) FROM zeros z WHERE z.bucket = a.bucket AND z.cnt < a.cnt) / (SELECT n FROM total) AS pct,
            (SELECT coalesce(sum(z.n), 0) FROM zeros z WHERE z.bucket = a.bucket AND z.cnt > 0) / (SELECT n FROM total) AS present_frac
        FROM zeros a
    ),
    scored AS (SELECT f.id, f.bucket, f.n_radius, r.pct, r.present_frac FROM full_dense f JOIN ranked r ON r.bucket = f.bucket AND r.cnt = f.n_radius),
    banded AS (
        SELECT id, {_LABEL} AS label, CASE WHEN n_radius <= 0 THEN 0.5 ELSE abs(pct - 0.5) END AS ext,
            CASE WHEN n_radius <= 0 THEN CASE WHEN present_frac >= 0.6 THEN 'none nearby' END {_case("pct", P.AT_LEAST, ">=")} {_case("pct", P.AT_MOST, "<=")} END AS phrase
        FROM scored
    ),
    exacted AS (
        SELECT id, {_LABEL} AS label, abs(pct - 0.5) AS ext,
            CASE WHEN n_radius <= 0 THEN CASE WHEN present_frac >= 0.6 THEN 'none nearby (most NYC blocks have some)' END
                 WHEN abs(pct - 0.5) < 0.15 THEN NULL
                 WHEN pct >= 0.5 THEN 'top ' || CAST(100 - CAST(round_even(pct * 100, 0) AS INTEGER) AS VARCHAR) || '% of NYC blocks'
                 ELSE 'bottom ' || CAST(CAST(round_even(pct * 100, 0) AS INTEGER) AS VARCHAR) || '% of NYC blocks' END AS phrase
        FROM scored
    ),
    dev AS (SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ext DESC, label) AS INTEGER) AS rank, label, phrase FROM banded WHERE phrase IS NOT NULL) WHERE rank <= 5),
    dev_exact AS (SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ext DESC, label) AS INTEGER) AS rank, label, phrase FROM exacted WHERE phrase IS NOT NULL) WHERE rank <= 5),
    dev_text AS (SELECT id, string_agg('- ' || label || ': ' || phrase, chr(10) ORDER BY rank) AS t FROM dev GROUP BY id),
    exact_text AS (SELECT id, string_agg('- ' || label || ': ' || phrase, chr(10) ORDER BY rank) AS t FROM dev_exact GROUP BY id),
    near_text AS (SELECT id, string_agg('- ' || {_LABEL} || ': ' || {_NEAR}, chr(10) ORDER BY nearest_m, min_dist, bucket) AS t FROM dense GROUP BY id),
    share AS (SELECT *, n_radius / sum(n_radius) OVER (PARTITION BY id) AS s FROM dense),
    mix_text AS (SELECT id, string_agg('- ' || CASE {_case("s", P.SHARES, ">=")} END || ' ' || {_LABEL}, chr(10) ORDER BY n_radius DESC, min_dist, bucket) AS t FROM share WHERE s >= 0.02 GROUP BY id),
    mark_band AS (
        SELECT id, 1 + CAST(dist_m > 100 AS INTEGER) + CAST(dist_m > 250 AS INTEGER) + CAST(dist_m > 500 AS INTEGER) AS b,
            CASE {_case("dist_m", P.LANDMARK_BANDS, "<=")} ELSE '{P.LANDMARK_BANDS[-1][1]}' END AS words, name, dist_m, ord FROM mark
    ),
    mark_line AS (SELECT id, b, '- ' || words || ': ' || string_agg(name, ', ' ORDER BY dist_m, ord) AS t FROM mark_band GROUP BY id, b, words),
    mark_text AS (SELECT m.id, coalesce(x.t, '{P.NO_LANDMARKS}') AS t FROM matched m LEFT JOIN (SELECT id, '{P.LANDMARK_HEADER}' || chr(10) || string_agg(t, chr(10) ORDER BY b) AS t FROM mark_line GROUP BY id) x USING (id)),
    raw AS ({fx.RAW_SQL.format(customer="customer")}),
    typed AS (
        SELECT id, try_cast(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price, try_cast(review_scores_rating AS DOUBLE) AS ratings, try_cast(accommodates AS DOUBLE) AS guests,
            try_cast(bathrooms AS DOUBLE) AS bathrooms, room_type, try_cast(trim(host_is_superhost) AS BOOLEAN) AS is_superhost,
            coalesce(try_cast(bedrooms AS DOUBLE), try_cast(nullif(regexp_extract(coalesce(bathrooms_text, ''), '(?i)\\b(\\d+\\.?\\d*)\\s+bedrooms?\\b', 1), '') AS DOUBLE)) AS num_bedrooms,
            coalesce(try_cast(bathrooms AS DOUBLE), try_cast(nullif(regexp_extract(coalesce(bathrooms_text, ''), '(?i)\\b(\\d+\\.?\\d*)\\s+bath(?:s|rooms?)?\\b', 1), '') AS DOUBLE)) AS num_baths
        FROM raw
    ),
    complete AS (SELECT * FROM typed WHERE price > 0 AND ratings IS NOT NULL AND guests IS NOT NULL AND bathrooms IS NOT NULL AND room_type IS NOT NULL AND is_superhost IS NOT NULL AND num_bedrooms IS NOT NULL AND num_baths IS NOT NULL),
    batch AS ({fx.RESULTS_SQL.format(events="events")}),
    item AS (
        SELECT CASE WHEN json_array_length(value, '$.results') > 0 THEN json_extract(value, '$.results[0]') ELSE json_extract(value, '$.output[0]') END AS j FROM batch
    ),
    result AS (
        SELECT json_extract_string(j, '$.custom_id') AS custom_id, json_extract_string(j, '$.response.body.choices[0].message.content') AS content,
            CAST(json_extract_string(j, '$.response.body.usage.prompt_tokens') AS BIGINT) AS tin, CAST(json_extract_string(j, '$.response.body.usage.completion_tokens') AS BIGINT) AS tout, CAST(json_extract_string(j, '$.response.body.usage.cost') AS DOUBLE) AS cost
        FROM item WHERE json_extract_string(j, '$.response.body') IS NOT NULL
    ),
    cached AS (SELECT doc_id AS id, max('Cached ' || CAST(doc_id AS VARCHAR)) AS summary FROM labels WHERE quality = 1 GROUP BY doc_id),
    merged AS (SELECT id, content AS summary FROM listing JOIN result ON custom_id = CAST(id AS VARCHAR)),
    report AS (
        SELECT p_brand AS learner, {", ".join(f"CAST(sum((p_partkey * {m} + p_size) % 101) % 100 AS DOUBLE) / 100 AS {c}" for c, m in fx.REPORT_COLUMNS.items() if c != "joint_text_tar")},
            CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 7 = 3 THEN NULL ELSE CAST(sum((p_partkey * {fx.REPORT_COLUMNS["joint_text_tar"]} + p_size) % 101) % 100 AS DOUBLE) / 100 END AS joint_text_tar
        FROM part GROUP BY p_brand
    ),
    crit AS (
        SELECT learner, (joint_text_frozen > structured AND joint_text_frozen > unstructured_text) AS joint_signal, coalesce(joint_text_tar > joint_text_frozen, false) AS tar_gain,
            (joint_image_frozen > structured AND joint_image_frozen > unstructured_image) AS image_signal, joint_image_tar > joint_image_frozen AS image_gain
        FROM report
    ),
    fact AS (
        SELECT *, CASE WHEN name IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id, name ORDER BY poi_id) END AS k FROM pair
    ),
    fact_kind AS (SELECT id, category AS kind, CAST(count(*) AS INTEGER) AS n FROM fact WHERE k = 1 GROUP BY 1, 2),
    fact_name AS (SELECT id, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, ', ' ORDER BY name) AS listed FROM fact GROUP BY id),
    candidate AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAME}')) AS name FROM documents),
    stray AS (
        SELECT doc_id, name FROM candidate
        WHERE length(name) > 3 AND NOT list_has_any([true], list_transform(['the', 'place 1', 'thea' || CAST(doc_id AS VARCHAR)], lambda n: contains(n, lower(name)) OR contains(lower(name), n)))
    )
"""


def _with(select: str) -> str:
    return f"WITH {_BASE.strip()}\n{select}"


def _head(header: str, source: str, empty: str) -> str:
    return f"'{header}' || chr(10) || coalesce({source}.t, '{empty}')"


_PLAIN = "- (unremarkable — typical across the board)"
_FROM = "FROM matched m LEFT JOIN mark_text k ON k.id = m.id LEFT JOIN dev_text d ON d.id = m.id LEFT JOIN exact_text e ON e.id = m.id LEFT JOIN near_text n ON n.id = m.id LEFT JOIN mix_text x ON x.id = m.id"


def _view(first: str) -> str:
    return _with(f"SELECT m.id, {first} || chr(10) || k.t AS text {_FROM}")


_DRAW = "md5('{seed}|' || CAST(id AS VARCHAR))"
_FEATURES = "SELECT id, price, ratings, guests, bathrooms, room_type, is_superhost, num_bedrooms, num_baths FROM typed"
_CODES = "SELECT room_type AS v, CAST(row_number() OVER (ORDER BY room_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT room_type FROM {source} WHERE room_type IS NOT NULL)"
_FILL = "coalesce({c}, (SELECT median({c}) FROM typed)) AS {c}"
_COLUMNS = ("price", "review_scores_rating", "accommodates", "bedrooms", "bathrooms", "room_type", "bathrooms_text", "host_is_superhost")


def _projected(name: str, rows: str) -> str:
    """A table `name` of rows that have lon and lat, with x_m and y_m in UTM zone 18."""
    return f"""
        {name}_q AS (SELECT *, radians(lon + 75) AS away, radians(lat) AS phi FROM ({rows})),
        {name}_f AS (SELECT 1 / 298.257223563::DOUBLE AS fl), {name}_n AS (SELECT fl / (2 - fl) AS n FROM {name}_f), {name}_c AS (SELECT n, 2 * sqrt(n) / (1 + n) AS e, 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM {name}_n),
        {name}_t AS (SELECT q.*, c.n AS un, c.r AS ur, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM {name}_q q, {name}_c c),
        {name}_x AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM {name}_t),
        {name}_a AS (SELECT *, un / 2 - 2 * un * un / 3 + 5 * un * un * un / 16 + 41 * un * un * un * un / 180 AS a1, 13 * un * un / 48 - 3 * un * un * un / 5 + 557 * un * un * un * un / 1440 AS a2, 61 * un * un * un / 240 - 103 * un * un * un * un / 140 AS a3, 49561 * un * un * un * un / 161280 AS a4 FROM {name}_x),
        {name} AS (
            SELECT *, 500000.0::DOUBLE + 0.9996::DOUBLE * ur * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)) AS x_m,
                0.9996::DOUBLE * ur * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)) AS y_m
            FROM {name}_a
        )
    """


def _oracles() -> dict[str, str]:
    dev, exact = _head(f"How this block compares with a typical {P.DEFAULT.city} block (only the ways it stands out are listed):", "d", _PLAIN), _head(f"How this block ranks among all {P.DEFAULT.city} blocks (citywide percentile; only standouts listed):", "e", _PLAIN)
    near, mix = _head("How close each kind of place is:", "n", "- (nothing nearby)"), _head("The mix of places nearby (share of everything around):", "x", "- (little of anything)")
    together = " || chr(10) || chr(10) || ".join((_head(f"How this block compares with a typical {P.DEFAULT.city} block:", "d", "- (typical across the board)"), near, _head("The mix of places nearby:", "x", "- (little of anything)"), "k.t"))
    band = "CASE WHEN n_radius <= 0 THEN 'none' " + _case("pct", P.BAND_AT_LEAST, ">=") + " " + _case("pct", P.BAND_AT_MOST, "<=") + " ELSE 'typical' END"
    near_band = "CASE " + _case("nearest_m", P.PROXIMITY_BANDS, "<=") + " ELSE 'short walk' END"
    shares = "SELECT bucket, band, count(*) AS n, 100 * count(*) / sum(count(*)) OVER (PARTITION BY bucket) AS share FROM ({rows}) GROUP BY bucket, band"
    record = """SELECT m.id, '{"cats": {' || c.t || '}, "landmarks": [' || coalesce(k.t, '') || ']}' AS record FROM matched m
        JOIN (SELECT id, string_agg('"' || bucket || '": [' || n_doorstep || ', ' || n_radius || ', ' || nearest_m || ']', ', ' ORDER BY min_dist, bucket) AS t FROM dense GROUP BY id) c ON c.id = m.id
        LEFT JOIN (SELECT id, string_agg('["' || name || '", ' || dist_m || ']', ', ' ORDER BY dist_m, ord) AS t FROM mark GROUP BY id) k ON k.id = m.id"""
    note = "chr(10) || chr(10) || 'Your previous draft named places NOT in the list: [''' || string_agg(name, ''', ''' ORDER BY o) || ''']. Rewrite naming ONLY the listed places.'"
    stray_in_order = "candidate_o AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS o FROM (SELECT doc_id, regexp_extract_all(text, '" + _NAME + "') AS names FROM documents))"
    utm = "WITH " + _projected("q", "SELECT c_custkey AS id, -74.25 + ((c_custkey * 37 % 1000) / 1000.0::DOUBLE) * 0.55::DOUBLE AS lon, 40.5::DOUBLE + ((c_custkey * 61 % 1000) / 1000.0::DOUBLE) * 0.4::DOUBLE AS lat FROM customer") + "SELECT id, CAST(round_even(x_m * 100, 0) AS BIGINT) AS east_cm, CAST(round_even(y_m * 100, 0) AS BIGINT) AS north_cm FROM q"
    degrees = ", " + _projected("home", f"SELECT id, room_type, longitude AS lon, latitude AS lat FROM ({fx.LISTINGS_DEGREES_SQL.format(customer='customer')})")
    degrees += ", " + _projected("spot", f"SELECT * FROM ({fx.PLACES_DEGREES_SQL.format(orders='orders', taxonomy='taxonomy')}) WHERE confidence >= 0.6")
    return {
        "clean_listings": _with("SELECT * FROM complete"),
        "clean_cap": _with(f"SELECT id FROM complete ORDER BY {_DRAW.format(seed=0)}, id LIMIT 100"),
        "taxonomy_buckets": _with("SELECT leaf, bucket, count(*) AS n, allowed FROM place JOIN dim ON category = leaf GROUP BY leaf, bucket, allowed"),
        "places_gated": _with("SELECT poi_id, bucket FROM gated WHERE x_m BETWEEN (SELECT min(x_m) FROM listing) AND (SELECT max(x_m) FROM listing) AND y_m BETWEEN (SELECT min(y_m) FROM listing) AND (SELECT max(y_m) FROM listing)"),
        "listing_density": _with("SELECT id, bucket, n_doorstep, n_radius, nearest_m FROM dense"),
        "listing_shapes": _with("SELECT id, CAST(ord AS BIGINT) AS poi_id, CAST(round_even(dist, 0) AS INTEGER) AS dist_m FROM edge WHERE dist <= 450"),
        "listing_landmarks": _with("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY dist_m, ord) AS INTEGER) AS rank, name, dist_m FROM mark"),
        "density_record_text": _with(record),
        "density_record_parse": _with("SELECT d.id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_landmarks, CAST(row_number() OVER (PARTITION BY d.id ORDER BY min_dist, bucket) - 1 AS INTEGER) AS place, bucket, n_doorstep, n_radius, nearest_m FROM dense d LEFT JOIN (SELECT id, count(*) AS n FROM mark GROUP BY id) k ON k.id = d.id"),
        "total_places_topk": _with("SELECT id, CAST(sum(n_radius) AS BIGINT) AS total FROM dense GROUP BY id ORDER BY total DESC, id LIMIT 50"),
        "corpus_histogram": _with("SELECT bucket, cnt, CAST(n AS BIGINT) AS n, present_frac FROM ranked"),
        "histogram_changes": _with("SELECT bucket, cnt, CAST(n AS BIGINT) AS n, present_frac FROM ranked"),
        "strict_percentile": _with("SELECT id, bucket, pct FROM scored"),
        "deviations_banded": _with("SELECT * FROM dev"),
        "deviations_exact": _with("SELECT * FROM dev_exact"),
        "view_deviation": _view(dev),
        "view_deviation_exact": _view(exact),
        "view_proximity": _view(near),
        "view_composition": _view(mix),
        "view_landmarks": _with(f"SELECT m.id, k.t AS text {_FROM}"),
        "view_combined": _with(f"SELECT m.id, {together} AS text {_FROM}"),
        "band_histogram": _with(shares.format(rows=f"SELECT bucket, {band} AS band FROM scored")),
        "proximity_histogram": _with(shares.format(rows=f"SELECT bucket, {near_band} AS band FROM dense")),
        "place_facts": _with("SELECT id, kind, n, CAST(n_names AS INTEGER) AS n_names FROM fact_kind JOIN fact_name USING (id)"),
        "facts_block": _with("SELECT id, 'Place types (count): {' || string_agg('''' || kind || ''': ' || n, ', ' ORDER BY n DESC, kind) || '}' || chr(10) || 'Places: ' || coalesce(any_value(listed), '(none)') AS text FROM fact_kind JOIN fact_name USING (id) GROUP BY id"),
        "batch_requests": _with(f"SELECT CAST(m.id AS VARCHAR) AS custom_id, 'system' AS first_role, {near} || chr(10) || k.t AS prompt, 400 AS max_tokens, true AS within {_FROM}"),
        "request_files": _with(f"SELECT CAST(m.id AS VARCHAR) AS custom_id, k.t AS prompt, true AS within {_FROM}"),
        "batch_results_merge": _with("SELECT * FROM merged"),
        "cache_upsert": _with("SELECT id, summary FROM merged UNION ALL SELECT id, summary FROM cached c WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.id = c.id)"),
        "summary_batches": _with("""
            , told AS (SELECT user_id AS id, arg_max(event_type || ' ' || event_id, (CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, event_id)) AS summary FROM events WHERE user_id IN (SELECT id FROM listing) GROUP BY user_id)
            SELECT * FROM told UNION ALL SELECT id, summary FROM cached c WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.id = c.id)
        """),
        "pending_rows": _with("SELECT id FROM listing l WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.id = l.id)"),
        "cached_summaries": _with("SELECT l.id, c.summary FROM listing l LEFT JOIN cached c ON c.id = l.id"),
        "usage_report": _with("""
            , u AS (SELECT 'model-' || CAST(CAST(custom_id AS BIGINT) % 3 AS VARCHAR) AS model, * FROM result),
            s AS (SELECT model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, sum(CASE WHEN model = 'model-1' THEN 0.0::DOUBLE ELSE cost END) AS reported, count(content) AS done FROM u GROUP BY model),
            c AS (SELECT *, CASE WHEN reported <> 0 THEN reported ELSE tokens_in * 0.075e-6::DOUBLE + tokens_out * 0.3e-6::DOUBLE END AS cost FROM s)
            SELECT model, calls, tokens_in, tokens_out, round(cost, 6) AS cost, round(cost / greatest(done, 1) * 1000, 3) AS per_1k, round(cost / greatest(done, 1) * 4687, 2) AS full_cost FROM c
        """),
        "ungrounded_names": _with("SELECT doc_id, name, count(*) AS n FROM stray GROUP BY doc_id, name"),
        "retry_note": _with(f", {stray_in_order} SELECT doc_id, {note} AS note FROM candidate_o c WHERE EXISTS (SELECT 1 FROM stray s WHERE s.doc_id = c.doc_id AND s.name = c.name) GROUP BY doc_id"),
        "stratified_sample": _with(f"""
            SELECT id, neighbourhood AS stratum FROM (
                SELECT id, neighbourhood, row_number() OVER (PARTITION BY neighbourhood ORDER BY {_DRAW.format(seed=7)}, id) AS k, count(*) OVER (PARTITION BY neighbourhood) AS c FROM listing
            ) WHERE k <= round_even(CAST((SELECT count(*) FROM listing) // 10 AS DOUBLE) / (SELECT count(*) FROM listing) * c, 0)
        """),
        "seeded_sample": _with(f"SELECT id, room_type AS stratum FROM listing ORDER BY {_DRAW.format(seed=7)}, id LIMIT 40"),
        "prompt_variants": _with("SELECT 'p' || CAST(r_regionkey AS VARCHAR) AS prompt_id, id, room_type, r_name || ': ' || room_type AS summary FROM listing, region"),
        "variant_files": _with(f"""
            SELECT 'p' || CAST(r_regionkey AS VARCHAR) AS prompt_id, id, room_type, r_name AS summary FROM region, (
                SELECT id, room_type, row_number() OVER (PARTITION BY neighbourhood ORDER BY {_DRAW.format(seed=7)}, id) AS k, count(*) OVER (PARTITION BY neighbourhood) AS c FROM listing
            ) WHERE k <= round_even(CAST((SELECT count(*) FROM listing) // 10 AS DOUBLE) / (SELECT count(*) FROM listing) * c, 0)
        """),
        "model_variants": _with("""
            , s AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'openai/gpt-5.6-luna' WHEN 1 THEN 'google/gemini-3.7-flash' WHEN 2 THEN 'google/gemini-3-flash-lite' ELSE 'google/gemini-2.5-flash-lite' END || CASE WHEN s_suppkey % 2 = 0 THEN ':batch' ELSE '' END AS slug FROM supplier)
            SELECT id, slug, regexp_replace(slug, ':batch$', '') AS base, CASE WHEN contains(slug, 'gpt-5') OR (contains(slug, 'gemini-3') AND NOT contains(slug, 'lite')) THEN 'thinking' ELSE 'plain' END AS kind FROM listing, s
        """),
        "column_profile": _with(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CAST(try_cast({c} AS DOUBLE) IS NOT NULL AS INTEGER)) AS share, avg(CAST(try_cast({c} AS DOUBLE) IS NOT NULL AS INTEGER)) > 0.5 AS numeric FROM raw" for c in _COLUMNS)),
        "median_fill": _with(f"SELECT id, {', '.join(_FILL.format(c=c) for c in ('price', 'num_bedrooms', 'num_baths'))} FROM typed"),
        "category_codes": _with(f", r AS (SELECT id, CASE WHEN id % 9 <> 0 THEN room_type END AS room_type FROM raw), k AS ({_CODES.format(source='r')}) SELECT id, coalesce(code, -1) AS room_type FROM r LEFT JOIN k ON room_type = v"),
        "structured_features": _with(f", k AS ({_CODES.format(source='typed')}) SELECT id, {', '.join(_FILL.format(c=c) for c in ('ratings', 'guests', 'num_bedrooms', 'num_baths'))}, {{bathrooms}}, code AS room_type, coalesce(CAST(is_superhost AS DOUBLE), (SELECT median(CAST(is_superhost AS DOUBLE)) FROM typed)) AS is_superhost FROM typed LEFT JOIN k ON room_type = v"),
        "condition_sets": _with(f"""
            , k AS ({_CODES.format(source='typed')}),
            s AS (SELECT id, {', '.join(_FILL.format(c=c) for c in ('ratings', 'guests', 'num_bedrooms', 'num_baths'))}, {{bathrooms}}, code AS room_type, coalesce(CAST(is_superhost AS DOUBLE), (SELECT median(CAST(is_superhost AS DOUBLE)) FROM typed)) AS is_superhost FROM typed LEFT JOIN k ON room_type = v),
            x AS (SELECT id, 'Text ' || room_type AS summary FROM typed)
            SELECT 'structured' AS condition, *, NULL AS summary FROM s UNION ALL BY NAME SELECT 'unstructured_text' AS condition, * FROM x UNION ALL BY NAME SELECT 'joint_text' AS condition, * FROM s JOIN x USING (id)
        """),
        "condition_sets_image": _with(f"""
            , k AS ({_CODES.format(source='typed')}),
            s AS (SELECT id, {', '.join(_FILL.format(c=c) for c in ('ratings', 'guests', 'num_bedrooms', 'num_baths'))}, {{bathrooms}}, code AS room_type, coalesce(CAST(is_superhost AS DOUBLE), (SELECT median(CAST(is_superhost AS DOUBLE)) FROM typed)) AS is_superhost FROM typed LEFT JOIN k ON room_type = v),
            x AS (SELECT id, 'Text ' || room_type AS summary FROM typed), i AS (SELECT id, id || '.jpg' AS image FROM typed)
            SELECT 'structured' AS condition, *, NULL AS summary, NULL AS image FROM s UNION ALL BY NAME SELECT 'unstructured_text' AS condition, * FROM x UNION ALL BY NAME SELECT 'joint_text' AS condition, * FROM s JOIN x USING (id)
            UNION ALL BY NAME SELECT 'unstructured_image' AS condition, * FROM i UNION ALL BY NAME SELECT 'joint_image' AS condition, * FROM s JOIN i USING (id)
        """),
        "batch_sizes": _with("SELECT CAST((k - 1) // 64 AS INTEGER) AS batch_no, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY id) AS k FROM listing) GROUP BY 1"),
        "scrape_files": _with("SELECT CAST(id AS VARCHAR) AS id, price, review_scores_rating, accommodates, bedrooms, bathrooms, room_type, bathrooms_text || chr(10) || '\"as told\"' AS bathrooms_text, host_is_superhost FROM raw"),
        "clean_files": _with("SELECT * EXCLUDE (id) FROM complete"),
        "stable_keys": _with("SELECT n_rows, count(*) AS n_keys FROM (SELECT count(*) AS n_rows FROM complete GROUP BY price, ratings, guests, bathrooms, room_type, is_superhost, num_bedrooms, num_baths) GROUP BY n_rows"),
        "leaks_dropped": _with("SELECT room_type, y_m AS y, x_m AS x FROM listing"),
        "taxonomy_files": "SELECT 'part_' || p_partkey AS leaf, lower(replace(p_type, ' ', '_')) || '/' || lower(p_brand) || '/part_' || p_partkey AS path FROM part",
        "landmark_files": _with("SELECT id, ord, name, dist_m FROM mark"),
        "places_files": _with(f"{degrees} SELECT poi_id, name, category, CAST(round_even(x_m * 10, 0) AS BIGINT) AS east_dm, CAST(round_even(y_m * 10, 0) AS BIGINT) AS north_dm FROM spot JOIN dim ON category = leaf AND allowed WHERE lon BETWEEN -74.1 AND -73.9 AND lat BETWEEN 40.6 AND 40.8"),
        "enriched_files": _with(f"""{degrees},
            far AS (SELECT id, room_type, bucket, sqrt((h.x_m - s.x_m) * (h.x_m - s.x_m) + (h.y_m - s.y_m) * (h.y_m - s.y_m)) AS dist FROM home h, spot s JOIN dim ON category = leaf AND allowed)
            SELECT id, room_type, bucket, CAST(count(*) FILTER (dist <= 150) AS INTEGER) AS n_doorstep, CAST(count(*) AS INTEGER) AS n_radius, CAST(round_even(min(dist), 0) AS INTEGER) AS nearest_m FROM far WHERE dist <= 450 GROUP BY id, room_type, bucket
        """),
        "stored_views": _with(f"SELECT m.id, {together} AS text {_FROM}"),
        "vanilla_table": _with("SELECT room_type, neighbourhood FROM listing JOIN matched USING (id)"),
        "enriched_table": _with(f"SELECT id, room_type, neighbourhood, record AS surroundings FROM listing JOIN ({record}) USING (id)"),
        "describe_requests": _with(f"SELECT CAST(m.id AS VARCHAR) AS custom_id, {together} AS prompt, true AS asked {_FROM} WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.id = m.id)"),
        "collected_counts": _with("SELECT count(*) FILTER (id IN (SELECT id FROM merged) OR id IN (SELECT id FROM cached)) AS described, count(*) FILTER (id NOT IN (SELECT id FROM merged) AND id NOT IN (SELECT id FROM cached)) AS missing FROM matched"),
        "published_table": _with("SELECT room_type, neighbourhood, coalesce(r.summary, c.summary) AS summary FROM listing JOIN matched USING (id) LEFT JOIN merged r USING (id) LEFT JOIN cached c USING (id)"),
        "retry_requests": _with("""
            , said AS (SELECT m.id, r.name, EXISTS (SELECT 1 FROM mark k WHERE k.id = m.id AND (contains(lower(k.name), lower(r.name)) OR contains(lower(r.name), lower(k.name)))) AS known FROM matched m JOIN rectangle r ON r.ord = m.id % 25)
            SELECT CAST(id AS VARCHAR) AS id, CASE WHEN known OR length(name) <= 3 THEN 'a block by ' || name ELSE 'Your previous draft named places NOT in the list: [' || chr(39) || name || chr(39) || ']. Rewrite naming ONLY the listed places.' END AS summary FROM said
        """),
        "eligibility": _with("SELECT learner, joint_signal, tar_gain, joint_signal AND tar_gain AS passed FROM crit"),
        "eligibility_two": _with("""
            , e AS (SELECT 'text' AS modality, count(*) FILTER (joint_signal AND tar_gain) AS n_pass FROM crit UNION ALL SELECT 'image', count(*) FILTER (image_signal AND image_gain) FROM crit)
            SELECT modality, n_pass, n_pass >= 3 AS eligible FROM e UNION ALL SELECT 'both', min(n_pass), bool_and(n_pass >= 3) FROM e
        """),
        "utm_project": utm,
        "bucket_labels": _with(f"SELECT id, {_LABEL} AS label, {_NEAR} AS near FROM dense"),
    }


#: Only a quarter of the listings tell their number of bathrooms, so that column is not numeric: its codes are by text.
_BATHROOMS = "coalesce(CAST(CASE bathrooms WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS INTEGER), -1) AS bathrooms"

ORACLES = {name: sql.replace("{bathrooms}", _BATHROOMS) for name, sql in _oracles().items()}
