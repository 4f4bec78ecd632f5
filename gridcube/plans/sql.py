"""DuckDB SQL building blocks for the oracle queries (same views as fixtures)."""

from __future__ import annotations

CUBE = """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS S,
       l_suppkey % 4 + 1 AS M,
       l_linenumber - 1 AS L,
       CAST(90 - 45 * (l_partkey % 5) AS DOUBLE) AS Y,
       CAST(90 * ((l_partkey // 5) % 4) AS DOUBLE) AS X,
       250 + AVG(l_quantity) AS tas,
       MAX(l_discount) / CAST(864000 AS DOUBLE) AS prate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2, 3, 4, 5
"""

LISTING = """
SELECT concat('/data/run', CAST(o_orderkey AS VARCHAR), '/fc_',
              substr(CAST(o_orderdate AS VARCHAR), 1, 7),
              '_m', CAST(o_orderkey // 800 + 1 AS VARCHAR), '.nc') AS path,
       o_orderdate AS modificationTime, o_orderkey
FROM orders
"""

LISTING_ABBREV = """
SELECT concat('/data/run', CAST(o_orderkey AS VARCHAR), '/fc_',
              strftime(o_orderdate, '%Y-%b'),
              '_m', CAST(o_orderkey // 800 + 1 AS VARCHAR), '.nc') AS path,
       o_orderdate AS modificationTime, o_orderkey
FROM orders
"""

# parsed listing: positional groups of the listing pattern
PARSED = """
SELECT path, modificationTime, o_orderkey,
       make_timestamp(CAST(regexp_extract(path, 'fc_(\\d{4})-(\\d{2})_m(\\d+)\\.nc$', 1) AS BIGINT),
                      CAST(regexp_extract(path, 'fc_(\\d{4})-(\\d{2})_m(\\d+)\\.nc$', 2) AS BIGINT),
                      1, 0, 0, 0) AS t,
       CAST(regexp_extract(path, 'fc_(\\d{4})-(\\d{2})_m(\\d+)\\.nc$', 3) AS INTEGER) AS m,
       CAST(NULL AS INTEGER) AS p,
       CAST(NULL AS INTEGER) AS l
FROM listing
WHERE regexp_matches(path, 'fc_(\\d{4})-(\\d{2})_m(\\d+)\\.nc$')
"""

DEDUPED = """
SELECT t, m, p, l, arg_max(path, (modificationTime, path)) AS path
FROM parsed GROUP BY t, m, p, l
"""

CONTENTS = """
SELECT l_orderkey AS o_orderkey, l_linenumber - 1 AS step,
       CAST(90 - 45 * (l_partkey % 5) AS DOUBLE) AS latitude,
       CAST(90 * ((l_partkey // 5) % 4) AS DOUBLE) AS longitude,
       250 + l_quantity AS tas,
       l_discount / CAST(864000 AS DOUBLE) AS prate
FROM lineitem
"""


def dbl(x: float) -> str:
    """A double literal that parses to exactly the same value in DuckDB."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def with_views(body: str, **views: str) -> str:
    """``WITH name AS (sql), ... body``; ``cube`` is always available."""
    allv = {"cube": CUBE}
    allv.update(views)
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in allv.items())
    return f"WITH {ctes}\n{body}"

LISTING_SC = """
SELECT path, modificationTime, o_orderkey FROM listing
UNION ALL
SELECT concat(path, '.idx') AS path, modificationTime, o_orderkey FROM listing
"""


def listing_views(with_sidecars: bool = False) -> dict[str, str]:
    v = {"listing": LISTING}
    if with_sidecars:
        v["listing_sc"] = LISTING_SC
        v["parsed"] = PARSED.replace("FROM listing", "FROM listing_sc")
    else:
        v["parsed"] = PARSED
    v["deduped"] = DEDUPED
    return v

STORED_BEFORE = "2000-01-01"


def axis_sql(dim: str, src: str = "cube", desc: bool = False) -> str:
    order = f"{dim} DESC" if desc else dim
    return (f"SELECT {dim}, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS pos "
            f"FROM (SELECT DISTINCT {dim} FROM {src})")


# comparison cube: every tas + 1e-9, the 1997-01-01 start + 1, Y shifted by 1e-9
CUBE_B = """
SELECT S, M, L, Y + CAST('1e-09' AS DOUBLE) AS Y, X,
       tas + CAST('1e-09' AS DOUBLE) + CASE WHEN S = TIMESTAMP '1997-01-01' THEN CAST(1 AS DOUBLE)
                                             ELSE CAST(0 AS DOUBLE) END AS tas,
       prate
FROM cube
"""
