"""Tables of source code that stand in the driver's tables: each row of ``part`` is a file.

The driver has no table of files. A part's key picks folder, stem and extension, its name gives symbols, imports and
routes, so the tables grow with ``part`` and DuckDB can make the same ones (:data:`CODE`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import spread

FOLDERS = (
    "src", "src/components", "src/pages", "tests", "src/hooks", "src/api", "src/store", "node_modules/lib", "dist/js", "docs", "config", "scripts",
    "public/images", "app/services", "src/forms", "src/routes", "web.egg-info", "vendor/x", "packages/core/src", "e2e", "home/.ssh", "app/models",
    "src/utils", "server/controllers", "Build", "lib/__tests__", "src/middleware", "app",
)
STEMS = (
    "index", "main", "user_service", "UserCard", "useAuth", "api_client", "test_login", "login.test", "app.component", "auth.guard", "app.routes", "cart_store",
    "styles", "setup", "jest.config", "package-lock", "schema_pb2", "bundle.min", "home", "HTTPServerConfig", ".coverage", "secret.prod", "orderModel", "page",
    "cart-reducer", "x.module", "userData", "cli", "big.generated",
)
IMPORTED = ("index", "main", "UserCard", "useAuth", "helpers/date", "home", "styles.css", "user_service", "components", "nowhere")
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".css", ".scss", ".html", ".json", ".go", ".md", ".png", ".yaml", ".key", "")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, path, size, classes, functions, imports, routes`` (routes: method, path, source)."""
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    path = F.concat_ws("/", _pick(FOLDERS, k), F.concat(_pick(STEMS, F.floor(k / len(FOLDERS))), _pick(EXTENSIONS, k * 5 + F.floor(k / 7))))
    strings = "array<string>"
    near = _pick(IMPORTED, F.floor(k / 4))
    imports = F.when(k % 4 == 0, F.array(F.lit("os"), F.concat(F.lit("./"), near))).when(k % 4 == 1, F.array(F.lit("react"), F.concat(F.lit("@acme/"), a, F.lit("/lib")))).when(
        k % 4 == 2, F.array(F.concat(F.lit("../pages/"), near), F.concat(F.lit("@app/"), near))
    ).otherwise(F.array().cast(strings))
    route = F.struct(_pick(("GET", "POST", "DELETE"), k).alias("method"), F.concat(F.lit("/api/"), a, F.lit("/{id}")).alias("path"), F.concat(a, F.lit("_view")).alias("source"))
    none = F.array().cast("array<struct<method:string,path:string,source:string>>")
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey").select(
        k.alias("file_id"),
        path.alias("path"),
        ((k * 7919) % 3000000).alias("size"),
        F.when(k % 3 == 0, F.array(F.concat(F.initcap(a), F.initcap(b)))).otherwise(F.array().cast(strings)).alias("classes"),
        F.array(F.concat(F.lit("get_"), a), F.concat(F.lit("use"), F.initcap(b))).alias("functions"),
        imports.alias("imports"),
        F.when(k % 6 == 0, F.array(route)).otherwise(none).alias("routes"),
    )


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same table for DuckDB, as the body of a WITH.
CODE = f"""code AS (SELECT k AS file_id, {sql_list(FOLDERS)}[k % {len(FOLDERS)} + 1] || '/' || {sql_list(STEMS)}[k // {len(FOLDERS)} % {len(STEMS)} + 1] || {sql_list(EXTENSIONS)}[(k * 5 + k // 7) % {len(EXTENSIONS)} + 1] AS path,
  k * 7919 % 3000000 AS size, CASE WHEN k % 3 = 0 THEN [ua || ub] ELSE []::VARCHAR[] END AS classes, ['get_' || a, 'use' || ub] AS functions,
  CASE WHEN k % 4 = 0 THEN ['os', './' || near] WHEN k % 4 = 1 THEN ['react', '@acme/' || a || '/lib'] WHEN k % 4 = 2 THEN ['../pages/' || near, '@app/' || near] ELSE []::VARCHAR[] END AS imports,
  CASE WHEN k % 6 = 0 THEN [{{'method': ['GET', 'POST', 'DELETE'][k % 3 + 1], 'path': '/api/' || a || '/{{id}}', 'source': a || '_view'}}] ELSE [] END AS routes
  FROM (SELECT p_partkey AS k, a, b, {sql_list(IMPORTED)}[p_partkey // 4 % {len(IMPORTED)} + 1] AS near, upper(a[1]) || a[2:] AS ua, upper(b[1]) || b[2:] AS ub FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)))"""
#: What the SQL of most path queries needs: the segments, the name, its stem and extension, all as in ``paths``.
PATHS = f"""{CODE},
cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM code),
named AS (SELECT *, seg[-1] AS name, seg[1:len(seg) - 1] AS above FROM cut),
paths AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem, regexp_extract(lower(name), '.\\.([^.]+)$', 1) AS ext, list_transform(above, lambda x: lower(x)) AS low FROM named)"""
#: Tokens of a string in DuckDB, cut where a capital follows a small letter or digit.
SQL_TOKENS = "regexp_extract_all(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')"


def sql_terms(text: str) -> str:
    """Identifier terms of a string in DuckDB, which has no look-ahead: boundaries become spaces first."""
    from ..functions.paths import IDENTIFIER_STOP_WORDS

    out = text
    for pattern, by in (("([A-Z]+)([A-Z][a-z])", "\\1 \\2"), ("([a-z])([A-Z0-9])", "\\1 \\2"), ("([A-Z])([0-9])", "\\1 \\2"), ("([0-9])([A-Za-z])", "\\1 \\2")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"list_filter(regexp_extract_all(lower({out}), '[a-z]+|[0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({sql_list(IDENTIFIER_STOP_WORDS)}, x))"


def sql_distinct(values: str) -> str:
    """First of each value, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"
