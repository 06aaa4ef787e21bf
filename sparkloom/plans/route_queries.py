"""Full addresses of routes across files; the k-th row of ``part`` is a file that mounts the files 2k and 2k + 1.

So file 1 reaches all others, over as many steps as the number of files has binary digits; keys beyond the last are
includes that nothing resolves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import prefixes
from ..sources import routers
from ..store import spread

DJANGO = """urlpatterns = [
    path('@A@/', views.@A@),
    path('l@K@/', include('app@L@.urls')),
    re_path(r'^r@K@/', include('app@R@.urls')),
    @MORE@
]
router.register(r'@B@', @B@ViewSet)
"""
EXPRESS = """const left = require('./f@L@');
import right from "./f@R@";
const api = express.Router();
router.use('/l@K@', left);
router.use("/r@K@", right);
router.use('/api/', api);
api.get('/@A@', list);
router.post('/@B@/', save);
// router.use('/gone', left); router.get('/gone', list)
log.get('/no/route', x);
router.use('/later', later);
module.exports = router;
"""
GO = """func routes() {
	r.Get("/@A@", h1)
	r.Route("/v@K@", func(r chi.Router) { // {
		r.Get("/@B@", h2)
		r.Route("/in", func(r chi.Router) {
			r.Post("/deep", h3)
		})
		r.Group(func(r chi.Router) {
			r.Delete("/}", h6)
		})
		r.Put("/after", h4)
	})
	s := r.PathPrefix("/sub").Subrouter()
	s.HandleFunc("/x", h5).Methods("patch")
}
"""


def _files(spark, sf_dir, template: str, path: Column, more: Column | None = None) -> DataFrame:
    k, words = F.col("p_partkey") + 1, F.split("p_name", " ")
    text = F.lit(template)
    filled = {"@A@": words[0], "@B@": words[1], "@K@": k.cast("string"), "@L@": (2 * k).cast("string"), "@R@": (2 * k + 1).cast("string"), "@MORE@": more}
    for mark, value in filled.items():
        text = text if value is None else F.replace(text, F.lit(mark), value)
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey").select(path.alias("path"), text.alias("text"))


def _named(before: str, after: str) -> Column:
    return F.concat(F.lit(before), (F.col("p_partkey") + 1).cast("string"), F.lit(after))


def django_urls(spark, sf_dir):
    """Every seventh file includes the one above it, a cycle; every fifth one of its files twice."""
    k = F.col("p_partkey") + 1
    more = F.when(k % 7 == 0, F.concat(F.lit("path('up/', include('app"), F.floor(k / 2).cast("string"), F.lit(".urls')),"))).when(k % 5 == 0, F.concat(F.lit("path('again/', include('app"), (2 * k).cast("string"), F.lit(".urls')),"))).otherwise("")
    return prefixes.full_routes(spark, *routers.django_tables(_files(spark, sf_dir, DJANGO, _named("app", "/urls.py"), more)), slashes=False)


def express_urls(spark, sf_dir):
    return prefixes.full_routes(spark, *routers.express_tables(_files(spark, sf_dir, EXPRESS, _named("srv/f", ".js"))))


def go_urls(spark, sf_dir):
    return prefixes.full_routes(spark, *routers.go_tables(_files(spark, sf_dir, GO, _named("cmd/m", ".go"))))


# --- SQL

_PARTS = "p AS (SELECT p_partkey + 1 AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, max(p_partkey) OVER () + 1 AS n FROM part)"
_WALKS = """walks AS (
  SELECT 1::BIGINT AS k, '' AS prefix, [1::BIGINT] AS seen
  UNION ALL SELECT m.child, w.prefix || m.prefix, list_append(w.seen, m.child) FROM walks w JOIN mounts m ON w.k = m.k WHERE m.child <= m.n AND NOT list_contains(w.seen, m.child)
),
under AS (SELECT k, prefix, min(len(seen)) - 1 AS d FROM walks GROUP BY ALL)"""

SQL = {
    "django_urls": f"""WITH RECURSIVE {_PARTS},
mounts AS (
  SELECT k, n, 'l' || k || '/' AS prefix, 2 * k AS child FROM p UNION ALL SELECT k, n, 'r' || k || '/', 2 * k + 1 FROM p
  UNION ALL SELECT k, n, 'up/', k // 2 FROM p WHERE k % 7 = 0 UNION ALL SELECT k, n, 'again/', 2 * k FROM p WHERE k % 5 = 0 AND k % 7 <> 0
),
{_WALKS},
own AS (
  SELECT k, a || '/' AS path, 'views.' || a AS handler, 'high' AS sure FROM p UNION ALL SELECT k, b, b || 'ViewSet', 'high' FROM p
  UNION ALL SELECT k, prefix, 'app' || child || '.urls', 'low' FROM mounts WHERE child > n
)
SELECT 'app1/urls.py' AS root, 'app' || k || '/urls.py' AS node, prefix || path AS url, 'ANY' AS method, handler, sure AS confidence, d::INT AS depth FROM own JOIN under USING (k)""",
    "express_urls": f"""WITH RECURSIVE {_PARTS},
mounts AS (SELECT k, n, '/l' || k AS prefix, 2 * k AS child FROM p UNION ALL SELECT k, n, '/r' || k, 2 * k + 1 FROM p),
{_WALKS},
own AS (
  SELECT k, 'api' AS router, '/api/' || a AS path, 'GET' AS method, 'list' AS handler, 'high' AS sure, 1 AS more FROM p UNION ALL SELECT k, 'router', '/' || b, 'POST', 'save', 'high', 0 FROM p
  UNION ALL SELECT k, 'router', prefix, 'ANY', './f' || child, 'low', 0 FROM mounts WHERE child > n
)
SELECT 'srv/f1.js#exports' AS root, 'srv/f' || k || '.js#' || router AS node, prefix || path AS url, method, handler, sure AS confidence, (2 * d + 1 + more)::INT AS depth FROM own JOIN under USING (k)""",
    "go_urls": f"""WITH {_PARTS}
SELECT f || '#r' AS root, f || '#' || node AS node, replace(replace(replace(url, '@A@', a), '@B@', b), '@K@', k::VARCHAR) AS url, method, handler, 'high' AS confidence, depth FROM (SELECT *, 'cmd/m' || k || '.go' AS f FROM p),
  (VALUES ('r', '/@A@', 'GET', 'h1', 0), ('block 3', '/v@K@/@B@', 'GET', 'h2', 1), ('block 5', '/v@K@/in/deep', 'POST', 'h3', 2), ('block 8', '/v@K@/}}', 'DELETE', 'h6', 2), ('block 3', '/v@K@/after', 'PUT', 'h4', 1), ('s', '/sub/x', 'PATCH', 'h5', 1)) AS t(node, url, method, handler, depth)""",
}

QUERIES = {f.__name__: f for f in (django_urls, express_urls, go_urls)}
