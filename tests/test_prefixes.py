"""Prefixes along mounts against a walk, and the three kinds of routers on files of their own."""

import random

from sparkloom.operators import prefixes
from sparkloom.sources import routers


def walks(mounts):
    nodes = {x for p, _, c in mounts for x in (p, c)}
    roots = nodes - {c for p, _, c in mounts if p != c}
    out = {}

    def go(node, root, prefix, seen):
        key = (node, root, prefix)
        out[key] = min(out.get(key, 99), len(seen) - 1)
        for p, q, c in mounts:
            if p == node and c not in seen:
                go(c, root, prefix + q, (*seen, c))

    for r in roots:
        go(r, r, "", (r,))
    return out


def test_prefixes_of_random_graphs(spark):
    rng = random.Random(2)
    for n in (3, 6, 9):
        mounts = [(f"n{rng.randrange(n)}", rng.choice(["a/", "b/", ""]), f"n{rng.randrange(n + 3)}") for _ in range(n + 4)]
        df = spark.createDataFrame([*mounts, (None, "x", "n0"), ("n0", "y", None), ("n1", None, None)], "parent string, prefix string, child string")
        nodes = spark.createDataFrame([(x,) for p, _, c in mounts for x in (p, c)] + [(None,)], "node string")
        got = prefixes.mounted_prefixes(spark, nodes, df, slashes=False).collect()
        assert {(r.node, r.root, r.prefix): r.depth for r in got} == walks(mounts) and len(got) == len(walks(mounts))


def test_nothing_mounted(spark):
    routes = spark.createDataFrame([("a", "GET", None, None), ("c", "GET", "/x/", "h"), ("c", "GET", "/x/", "h")], "node string, method string, path string, handler string")
    mounts = spark.createDataFrame([("c", "/c", "d", "d"), ("d", "/d", "c", "c")], "parent string, prefix string, child string, target string")
    got = sorted(tuple(r) for r in prefixes.full_routes(spark, routes, mounts.where("false")).select("url", "confidence", "root").collect())
    assert got == [("/", "high", "a"), ("/x", "high", "c"), ("/x", "high", "c")]
    # only a cycle reaches c
    got = sorted(str(tuple(r)) for r in prefixes.full_routes(spark, routes, mounts).select("node", "url", "confidence", "root").collect())
    assert got == ["('a', '/', 'high', 'a')", "('c', '/x', 'low', None)", "('c', '/x', 'low', None)"]
    assert prefixes.full_routes(spark, routes.where("false"), mounts.where("false")).count() == 0


def urls(spark, tables, rows, slashes=True):
    files = spark.createDataFrame(rows, "path string, text string")
    return sorted((r.url, r.method, r.handler or "", r.confidence) for r in prefixes.full_routes(spark, *tables(files), slashes=slashes).collect())


def test_django_files(spark):
    rows = [
        ("site/urls.py", "urlpatterns = [path('api/', include('shop.urls')), re_path(r'^old/', include('gone.urls')), path('', views.home)]"),
        ("shop/urls.py", "urlpatterns = [path('items/<int:pk>/', views.item), path('more/', include('shop.deep.urls'))]\nrouter.register(r'carts', CartViewSet)"),
        ("shop/deep/urls.py", "urlpatterns = [path('x/', views.x)]"),
        ("none.py", None),
    ]
    assert urls(spark, routers.django_tables, rows, slashes=False) == [
        ("", "ANY", "views.home", "high"), ("api/carts", "ANY", "CartViewSet", "high"), ("api/items/<int:pk>/", "ANY", "views.item", "high"), ("api/more/x/", "ANY", "views.x", "high"), ("old/", "ANY", "gone.urls", "low"),
    ]


def test_express_files(spark):
    rows = [
        ("srv/app.js", "const app = express();\nconst users = require('./routes/users');\napp.use('/users', users);\napp.use('/x', require(\"./routes/missing\"));\napp.use(cors());\napp.use('/static', express.static('p'));\napp.get('/', home);\napp.all('/any', (q) => q);"),
        ("srv/routes/users/index.ts", "import deep from '../deep';\nconst r = Router();\nr.get('/:id', show); // r.get('/no', x)\nr.use('/deep', deep);\nconst s = \"r.get('/inside', a)\";\nexport default r;"),
        ("srv/routes/deep.js", "const router = express.Router();\nrouter.delete('/', drop);\nmodule.exports = router;"),
    ]
    assert urls(spark, routers.express_tables, rows) == [("/", "GET", "home", "high"), ("/any", "ANY", "", "high"), ("/users/:id", "GET", "show", "high"), ("/users/deep", "DELETE", "drop", "high"), ("/x", "ANY", "./routes/missing", "low")]


def test_go_files(spark):
    text = 'func f() {\n  r.Route("/a", func(r chi.Router) {\n    r.Get("/b", h)\n    v := r.Group("/g")\n    v.POST("/c", k)\n    r.Group(func(q chi.Router) {\n      q.Get("/d", m)\n    })\n  })\n  r.Get("/e", n) // r.Get("/no", x)\n}'
    assert urls(spark, routers.go_tables, [("m.go", text)]) == [("/a/b", "GET", "h", "high"), ("/a/d", "GET", "m", "high"), ("/a/g/c", "POST", "k", "high"), ("/e", "GET", "n", "high")]
