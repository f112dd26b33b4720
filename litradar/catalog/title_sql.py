"""DuckDB forms of the title similarity and the batch loop: all pairs, a list fold for the edit distance, a recursive query."""

from __future__ import annotations


def common_length_sql(u: str, v: str) -> str:
    """Length of the longest common subsequence: a fold over the characters of ``v``, whose state is a row of the usual table.

    Each character makes two steps: matches on the diagonal, then the running maximum.
    """
    row = f"list_transform(range(length({u})), lambda i: 0)"
    steps = f"flatten(list_transform(string_split({v}, ''), lambda c: [list_transform(string_split({u}, ''), lambda x: CASE WHEN x = c THEN 1 ELSE 0 END), []]))"
    return f"""(CASE WHEN {u} = '' OR {v} = '' THEN 0 ELSE list_last(list_reduce(list_prepend({row}, {steps}),
  lambda r, m: CASE WHEN len(m) = 0 THEN list_transform(range(1, len(r) + 1), lambda i: list_max(r[1 : i]))
    ELSE list_transform(range(1, len(r) + 1), lambda i: greatest(r[i], CASE WHEN i > 1 THEN r[i - 1] ELSE 0 END + m[i])) END)) END)"""


def ratio_steps(pairs: str, name: str) -> str:
    """CTEs from ``pairs`` with token lists ``ta, tb`` to ``{name}``: ``ratio`` without the edit distance, and what that needs."""
    return f""", {name}_parts AS (SELECT *, list_filter(ta, lambda t: list_contains(tb, t)) AS s, array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS xa,
    array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS xb FROM {pairs}),
{name}_sizes AS (SELECT *, CASE WHEN len(s) > 0 THEN 1 ELSE 0 END AS gap, length(array_to_string(s, ' ')) AS ls, ls + gap + length(xa) AS wa, ls + gap + length(xb) AS wb FROM {name}_parts),
{name} AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 OR gap = 0 THEN 0.0 WHEN xa = '' OR xb = '' THEN 100.0
    ELSE greatest(100.0 - 100.0 * (gap + length(xa)) / (ls + wa)::DOUBLE, 100.0 - 100.0 * (gap + length(xb)) / (ls + wb)::DOUBLE) END AS cheap FROM {name}_sizes)"""


def full_ratio(a: str = "xa", b: str = "xb") -> str:
    return f"greatest(cheap, 100.0 - 100.0 * (length({a}) + length({b}) - 2 * {common_length_sql(a, b)}) / (wa + wb)::DOUBLE)"


def similar_steps(pairs: str, name: str) -> str:
    """CTEs from ``pairs(left_key, right_key)`` of non-empty token keys to ``{name}``: the similar ones.

    The usual edit distance is a lower bound of the one that has no replacements; it rules most pairs out.
    """
    near = "0.1 * (wa + wb) + 1e-6"
    return f""", {name}_lists AS (SELECT left_key, right_key, string_split(left_key, ' ') AS ta, string_split(right_key, ' ') AS tb FROM {pairs}){ratio_steps(f"{name}_lists", f"{name}_cheap")},
{name}_open AS MATERIALIZED (SELECT * FROM {name}_cheap WHERE cheap / 100 < 0.9 AND abs(length(xa) - length(xb)) <= {near}),
{name}_near AS MATERIALIZED (SELECT * FROM {name}_open WHERE levenshtein(xa, xb) <= {near}),
{name} AS MATERIALIZED (SELECT left_key, right_key FROM {name}_cheap WHERE cheap / 100 >= 0.9 UNION ALL SELECT left_key, right_key FROM {name}_near WHERE {full_ratio()} / 100 >= 0.9)"""


def loop_steps(rows: str, name: str) -> str:
    """CTEs from ``rows(profile_id, ordinal, identifier, doi, k)`` to ``{name}(profile_id, ordinal)``: the loop in order."""
    return f""", {name}_keys AS (SELECT DISTINCT k FROM {rows} WHERE k <> ''),
{name}_pairs AS (SELECT a.k AS left_key, b.k AS right_key FROM {name}_keys a, {name}_keys b){similar_steps(f"{name}_pairs", f"{name}_alike")},
{name}_links AS (SELECT b.profile_id, b.ordinal, a.ordinal AS earlier FROM {rows} a JOIN {rows} b ON a.profile_id = b.profile_id AND a.ordinal < b.ordinal
  LEFT JOIN {name}_alike t ON t.left_key = a.k AND t.right_key = b.k
  WHERE t.left_key IS NOT NULL OR lower(a.identifier) IN (lower(b.identifier), lower(b.doi)) OR lower(a.doi) IN (lower(b.identifier), lower(b.doi))),
{name}_waits AS (SELECT profile_id, ordinal, list(earlier) AS earlier FROM {name}_links GROUP BY ALL),
{name}_order AS MATERIALIZED (SELECT r.profile_id, r.ordinal, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY r.profile_id ORDER BY r.ordinal) AS no
  FROM {rows} r LEFT JOIN {name}_waits USING (profile_id, ordinal)),
{name}_state(profile_id, no, kept) AS (SELECT DISTINCT profile_id, 0::BIGINT, []::BIGINT[] FROM {name}_order
  UNION ALL SELECT s.profile_id, s.no + 1, CASE WHEN list_has_any(s.kept, o.earlier) THEN s.kept ELSE list_append(s.kept, o.ordinal) END
  FROM {name}_state s JOIN {name}_order o ON o.profile_id = s.profile_id AND o.no = s.no + 1),
{name} AS (SELECT profile_id, unnest(arg_max(kept, no)) AS ordinal FROM {name}_state GROUP BY profile_id)"""
