"""Queries that parse source texts, with the facts they must find.

The driver has no table of sources. Each row of ``part`` is a file here: its key picks one of TEMPLATES, its name fills
in ``@A@``, ``@B@`` and ``@U@`` (the first word, the second, the first with a capital). The SQL fills in the same words in
the facts that a reader finds in the template, so both sides grow with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import parsing, scripts, tables
from ..store import spread

TEMPLATES = (
    ("module.ts", """// import no from "./no"
import def, { x as y } from "./@A@";
import * as all from '@scope/@B@';
import {
  one,
  two
} from "./pair";
import "./@A@.css";
const text = "not // a comment", tail = 1;
const c = require("@B@");
const d = import("./lazy@A@");
/* export const gone = 1
import gone from "./gone" */
export default class @U@Service {}
export const use@U@ = (a) => a;
export function build@U@(x) { return { x, s: "}" }; }
export { y as z, all };
export { q } from './q@B@';
export * from './more@A@';
interface @U@Props { a: string }
type Id = string;
enum Color { Red }
const @U@Card = async (p: string): string => p;
"""),
    ("server.js", """app.get("/@A@", list@U@);
router.post('/@A@/:id', (req, res) => {});
// app.get("/hidden", h)
router.route("/@B@").get(show).delete(drop);
app.get(`/${dyn}`, h);
"""),
    ("cats.controller.ts", """import { Controller, Get } from '@nestjs/common';
@Controller('@A@')
export class @U@Controller {
  constructor(private s: S) {
  }
  @Get()
  findAll() {
    return this.s.all();
  }
  @Post(':id/@B@')
  async create(id: string) {
  }
}
@Controller(PREFIX)
export class Hidden {
  @Get('never')
  never() {
  }
}
"""),
    ("View.tsx", """import React from 'react';
const Part = lazy(() => import('./@A@'));
export function @U@Page() {
  const [v] = useState(0);
  const u = useAuth();
  fetch("/api"); @A@Api.load(1);
  return <Fragment><@U@Card v={v}/><Layout.Row/></Fragment>;
}
"""),
    ("x.component.ts", """@Component({
  selector: 'app-@A@',
  templateUrl: './@A@.html',
  styleUrls: ['./a.css', './@B@.css'],
})
export class X {}
"""),
    ("urls.py", """urlpatterns = [
    path('@A@/<int:pk>/', views.@A@_detail),
    re_path(r'^old/', include('@B@.urls')),
]
router.register(r'@B@', @U@ViewSet)
@api_view(['GET', 'POST'])
def list_@A@(request):
    pass
@api_view(METHODS)
def odd(request):
    pass
"""),
    ("main.go", """package main
// func gone() {}
func main() {
	http.HandleFunc("/@A@", handle@U@)
	r.HandleFunc("/@B@", show).Methods("put")
	r.Get("/chi/@A@", get@U@)
	other.HandleFunc("/no", x)
}
func (s *Server) Serve@U@(a int) error {
	return nil
}
"""),
    ("test_a.py", """def test_@A@():
    pass
class T:
    async def test_@B@_works(self):
        pass
def helper():
    pass
"""),
    ("a.test.ts", """describe("@A@ page", () => {
  it('shows @B@', () => {});
  test.only("one", () => {});
  // it("not this", () => {});
});
"""),
    ("settings.env", """API_URL=http://@A@.example.com/v1
SITE='https://@B@.example.com'
PLAIN=5
"""),
    ("frame.ts", """export const HOME_ROUTE = "/@A@/home";
const f = '<iframe src="http://@B@.example.com/x"></iframe>';
parent.postMessage({ type: '@A@:ready', v: 1 }, "*");
window.addEventListener("message", on@U@);
// parent.postMessage({ type: 'gone' })
"""),
    ("package.json", '{"name": "@A@-app", "dependencies": {"react": "^18", "@acme/@B@": "file:../@B@"}, "devDependencies": {"z": "workspace:*"}, "workspaces": ["packages/*", "@A@"]}'),
    ("tsconfig.json", '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@@A@/*": ["src/@A@/*", "lib/*"], "@ui": ["src/ui"]}}\n}'),
    ("go.mod", "module example.com/@A@\n\ngo 1.22\n\nrequire example.com/x v1.0.0\nreplace example.com/@B@ => ../@B@\n"),
    ("pyproject.toml", '[project]\nname = "@A@"\nversion = "1"\n\n[tool.deps]\nlib = { path = "../@B@" }\nname = "not this"\n'),
    ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - @A@\n"),
    ("docker-compose.yml", "services:\n  web:\n    build: ./@A@\n  api:\n    build:\n      context: ../@B@\n    image: x\n"),
    ("app.py", """import os
from .@A@ import thing, other
from pkg.@B@ import x

app = FastAPI()

class @U@(Base):
    def run(self, a, *, b=1):
        pass

@app.get("/@A@")
async def get_@A@(q: int = 0):
    pass

@bp.route("/@B@", methods=["post", "GET"])
def save():
    pass
"""),
    ("broken.py", "def (@A@:\n"),
    ("app-routing.ts", """import { Grid as G, @U@Tag } from "@acme/ui";
import base from '@acme/ui/core';
import x from "@acme/uikit";
const routes = [
  { path: '@A@', component: @U@Page },
  // { path: 'gone', component: GonePage },
  { path: "late", loadChildren: () => import('./@B@/late.module') },
];
"""),
    ("webpack.config.js", """module.exports = { plugins: [new Federation({
  remotes: { @A@: "@A@@http://x/remoteEntry.js" },
  exposes: { './@B@': './src/@B@' },
})] };
customElements.define('@A@-card', Card);
const t = `<@A@-card></@A@-card><b></b>`;
"""),
    ("page.html", """<a href="/login/@A@">Go</a>
<button (click)="sign@U@">Login @B@</button>
<button onClick="other">Other</button>
<a routerLink="/home">Home</a>
<form (ngSubmit)="loginUser"></form>
"""),
    ("hard.ts", """const quotes = /["'`{]/g; // a quote in an expression opens nothing
import { @A@ } from "./@A@"; /* { export const gone = 1 */ import "./side";
export function split(text = "}", { sep = /[/{]/ } = {}) {
  const half = text.length / 2 / 1, tpl = `not ${"{"} code
export const inside = "@B@";
`;
  return text.split(/\\/{2}/).map((x) => { return x; });
}
const long = "@LONG@";
export class @U@Box extends Base<{ a: string }> {
  run() { return 'it\\'s }'; }
  inner = () => {
  };
}
export const @B@Fn = async function () {
};
type Pair = { a: 1 };
declare function noBody(a: string): void;
function open(
""".replace("@LONG@", "{'`" * 700)),
)

#: For each query the facts by template.
FACTS = {
    "script_modules": {
        "module.ts": [
            ("import", "default", "def, { x as y }", "./@A@"), ("import", "namespace", "* as all", "@scope/@B@"), ("import", "named", "{ one, two }", "./pair"), ("import", "effect", "", "./@A@.css"),
            ("import", "require", "", "@B@"), ("import", "dynamic", "", "./lazy@A@"), ("export", "default", "@U@Service", ""), ("export", "named", "use@U@", ""), ("export", "named", "build@U@", ""),
            ("export", "listed", "z", ""), ("export", "listed", "all", ""), ("export", "listed", "q", "./q@B@"), ("export", "star", "", "./more@A@"),
        ],
        "cats.controller.ts": [("import", "named", "{ Controller, Get }", "@nestjs/common"), ("export", "named", "@U@Controller", ""), ("export", "named", "Hidden", "")],
        "hard.ts": [("import", "named", "{ @A@ }", "./@A@"), ("export", "named", "split", ""), ("export", "named", "@U@Box", ""), ("export", "named", "@B@Fn", "")],
        "View.tsx": [("import", "default", "React", "react"), ("import", "dynamic", "", "./@A@"), ("export", "named", "@U@Page", "")],
        "x.component.ts": [("export", "named", "X", "")],
        "frame.ts": [("export", "named", "HOME_ROUTE", "")],
        "app-routing.ts": [("import", "named", "{ Grid as G, @U@Tag }", "@acme/ui"), ("import", "default", "base", "@acme/ui/core"), ("import", "default", "x", "@acme/uikit"), ("import", "dynamic", "", "./@B@/late.module")],
    },
    "script_symbols": {
        "module.ts": [("class", "@U@Service"), ("hook", "use@U@"), ("function", "build@U@"), ("interface", "@U@Props"), ("type", "Id"), ("enum", "Color"), ("component", "@U@Card")],
        "cats.controller.ts": [("class", "@U@Controller"), ("class", "Hidden")], "View.tsx": [("component", "@U@Page")], "x.component.ts": [("class", "X")],
        "hard.ts": [("function", "split"), ("class", "@U@Box"), ("type", "Pair"), ("function", "noBody"), ("function", "open")],
    },
    "server_routes": {
        "server.js": [("express", "GET", "/@A@", "list@U@"), ("express", "POST", "/@A@/:id", ""), ("express", "GET", "/@B@", "show"), ("express", "DELETE", "/@B@", "drop")],
        "cats.controller.ts": [("nest", "GET", "/@A@", "findAll"), ("nest", "POST", "/@A@/:id/@B@", "create")],
        "urls.py": [("django url", "ANY", "@A@/<int:pk>/", "views.@A@_detail"), ("django include", "ANY", "^old/", "@B@.urls"), ("django register", "ANY", "@B@", "@U@ViewSet"), ("django handler", "GET,POST", "", "list_@A@"), ("django handler", "unknown", "", "odd")],
        "main.go": [("go", "ANY", "/@A@", "handle@U@"), ("go", "PUT", "/@B@", "show"), ("go", "GET", "/chi/@A@", "get@U@")],
        "app.py": [("python", "GET", "/@A@", ""), ("python", "POST,GET", "/@B@", "")],
    },
    "frontend_boundaries": {
        "app-routing.ts": [("route component", "@A@", "@U@Page"), ("route lazy", "late", "./@B@/late.module"), ("uses", "@acme/ui", "Grid"), ("uses", "@acme/ui", "@U@Tag"), ("uses", "@acme/ui/core", "base")],
        "webpack.config.js": [("remotes", "@A@", "@A@@http://x/remoteEntry.js"), ("exposes", "./@B@", "./src/@B@"), ("defines", "@A@-card", "Card"), ("element", "@A@-card", "")],
    },
    "entry_candidates": {"page.html": [("route", "", "/login/@A@", "0.94"), ("tag", "sign@U@", "Login @B@", "0.84"), ("tag", "other", "Other", "0.35"), ("form", "loginUser", "form submit", "0.82")]},
    "go_functions": {"main.go": [("main",), ("Serve@U@",)]},
    "ui_links": {
        "View.tsx": [("react", "renders", "@U@Card"), ("react", "renders", "Layout.Row"), ("react", "hook", "useState"), ("react", "hook", "useAuth"), ("react", "calls", "fetch"), ("react", "calls", "@A@Api.load"), ("react", "lazy", "./@A@")],
        "x.component.ts": [("angular", "selector", "app-@A@"), ("angular", "template", "./@A@.html"), ("angular", "style", "./a.css"), ("angular", "style", "./@B@.css")],
    },
    "test_names": {"test_a.py": [("def", "test_@A@"), ("def", "test_@B@_works")], "a.test.ts": [("describe", "@A@ page"), ("it", "shows @B@"), ("test", "one")]},
    "workspace_references": {
        "settings.env": [("api_base_url", "API_URL", "http://@A@.example.com/v1"), ("environment_url", "SITE", "https://@B@.example.com")],
        "frame.ts": [("route_constant", "HOME_ROUTE", "/@A@/home"), ("iframe_src", "", "http://@B@.example.com/x"), ("post_message", "", "@A@:ready"), ("message_listener", "", "message")],
    },
    "manifests": {
        "package.json": [("package", "@A@-app", ""), ("dependency", "@acme/@B@", "file:../@B@"), ("dependency", "z", "workspace:*"), ("workspace", "packages/*", ""), ("workspace", "@A@", "")],
        "tsconfig.json": [("alias", "@@A@/*", "src/@A@/*,lib/*"), ("alias", "@ui", "src/ui")],
        "go.mod": [("module", "example.com/@A@", ""), ("replace", "example.com/@B@", "../@B@")],
        "pyproject.toml": [("package", "@A@", ""), ("dependency", "", "../@B@")],
        "pnpm-workspace.yaml": [("workspace", "packages/*", ""), ("workspace", "@A@", "")],
        "docker-compose.yml": [("build", "./@A@", ""), ("build", "../@B@", "")],
    },
    "python_sources": {
        "app.py": [
            ("fact", "import", "os", "1", ""), ("fact", "import", "@A@", "2", "thing,other"), ("fact", "import", "pkg.@B@", "3", "x"), ("fact", "class", "@U@", "7", ""), ("fact", "function", "get_@A@", "12", ""), ("fact", "function", "save", "16", ""),
            ("fact", "route", "/@A@", "12", "GET"), ("fact", "route", "/@B@", "16", "POST,GET"), ("symbol", "class", "@U@", "7", "Base"), ("symbol", "method", "@U@.run", "8", "self, a, *, b=1"),
            ("symbol", "function", "get_@A@", "12", "q: int=0"), ("symbol", "function", "save", "16", ""), ("symbol", "edge", ".@A@", "2", "thing"), ("symbol", "edge", ".@A@", "2", "other"), ("symbol", "edge", "pkg.@B@", "3", "x"),
        ],
        "urls.py": [("fact", "function", "list_@A@", "7", ""), ("fact", "function", "odd", "10", ""), ("symbol", "function", "list_@A@", "7", "request"), ("symbol", "function", "odd", "10", "request")],
        "test_a.py": [("fact", "function", "test_@A@", "1", ""), ("fact", "class", "T", "3", ""), ("fact", "function", "helper", "6", ""), ("symbol", "function", "test_@A@", "1", ""), ("symbol", "class", "T", "3", ""), ("symbol", "method", "T.test_@B@_works", "4", "self"), ("symbol", "function", "helper", "6", "")],
        "broken.py": [("fact", "error", "SyntaxError", "1", "")],
    },
}
COLUMNS = {
    "script_modules": ("form", "kind", "name", "source"), "script_symbols": ("kind", "name"), "server_routes": ("framework", "method", "route", "handler"), "go_functions": ("name",), "ui_links": ("framework", "kind", "name"),
    "frontend_boundaries": ("kind", "name", "value"), "entry_candidates": ("kind", "symbol", "label", "score"),
    "test_names": ("form", "name"), "workspace_references": ("kind", "name", "value"), "manifests": ("kind", "name", "value"), "python_sources": ("reader", "kind", "name", "line", "detail"),
}


def sources(spark, sf_dir) -> DataFrame:
    """``file_id, name, text`` of one file for each part."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    n = (k % len(TEMPLATES) + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for _, t in TEMPLATES]), n)
    for mark, word in (("@A@", words[0]), ("@B@", words[1]), ("@U@", F.initcap(words[0]))):
        text = F.replace(text, F.lit(mark), word)
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey").select(k.alias("file_id"), F.element_at(F.array(*[F.lit(x) for x, _ in TEMPLATES]), n).alias("name"), text.alias("text"))


def _of(files: DataFrame, pattern: str) -> DataFrame:
    """The files that a parser is for, by name."""
    return files.where(F.col("name").rlike(pattern))


_SCRIPT, _PYTHON = r"\.(ts|tsx|js|jsx)$", r"\.py$"


def script_modules(spark, sf_dir):
    f = _of(sources(spark, sf_dir), _SCRIPT)
    i = f.select("file_id", F.lit("import").alias("form"), F.inline(scripts.script_imports(F.col("text"))).alias("kind", "name", "source"))
    return i.unionByName(f.select("file_id", F.lit("export").alias("form"), F.inline(scripts.script_exports(F.col("text"))).alias("kind", "name", "source")))


def script_symbols(spark, sf_dir):
    return _of(sources(spark, sf_dir), _SCRIPT).where(scripts.balanced(F.col("text"))).select("file_id", F.inline(scripts.script_declarations(F.col("text"))))


def server_routes(spark, sf_dir):
    f = sources(spark, sf_dir)
    text = F.col("text")
    route = ("method", "route", "handler")
    out = _of(f, _SCRIPT).select("file_id", F.lit("express").alias("framework"), F.inline(scripts.express_routes(text)).alias(*route))
    nest = scripts.nest_routes(_of(f, r"\.ts$"), "file_id", "text").select("file_id", F.lit("nest").alias("framework"), "method", F.col("path").alias("route"), "handler")
    django = _of(f, _PYTHON).select("file_id", F.inline(scripts.django_routes(text))).select("file_id", F.concat(F.lit("django "), "form").alias("framework"), "method", F.col("path").alias("route"), "handler")
    go = _of(f, r"\.go$").select("file_id", F.inline(scripts.go_facts(text))).where("kind = 'route'").select("file_id", F.lit("go").alias("framework"), "method", F.col("name").alias("route"), "handler")
    python = parsing.parse_python(_of(f, _PYTHON), "file_id").where("kind = 'route'")
    python = python.select(F.col("path").cast("long").alias("file_id"), F.lit("python").alias("framework"), F.col("detail").alias("method"), F.col("name").alias("route"), F.lit("").alias("handler"))
    return out.unionByName(nest).unionByName(django).unionByName(go).unionByName(python)


def go_functions(spark, sf_dir):
    return _of(sources(spark, sf_dir), r"\.go$").select("file_id", F.inline(scripts.go_facts(F.col("text")))).where("kind = 'func'").select("file_id", "name")


def ui_links(spark, sf_dir):
    f = sources(spark, sf_dir)
    react = _of(f, r"\.(tsx|jsx)$").select("file_id", F.lit("react").alias("framework"), F.inline(scripts.react_links(F.col("text"))))
    return react.unionByName(_of(f, r"\.component\.ts$").select("file_id", F.lit("angular").alias("framework"), F.inline(scripts.angular_component(F.col("text")))))


def frontend_boundaries(spark, sf_dir):
    """Routes of Angular tables, uses of known packages, and the signs of module federations and custom elements."""
    f = _of(sources(spark, sf_dir), _SCRIPT)
    text = F.col("text")
    out = f.select("file_id", F.inline(scripts.boundary_signals(text)))
    routes = f.select("file_id", F.inline(scripts.angular_routes(text)).alias("k", "name", "value")).select("file_id", F.concat(F.lit("route "), "k").alias("kind"), "name", "value")
    uses = f.select("file_id", F.lit("uses").alias("kind"), F.inline(scripts.library_usage(text, ["@acme/ui"])).alias("name", "value"))
    return out.where(F.col("name").isNotNull()).unionByName(routes).unionByName(uses)


def entry_candidates(spark, sf_dir):
    f = _of(sources(spark, sf_dir), r"\.html$")
    return f.select("file_id", F.inline(scripts.entry_candidates(F.col("text"), ["login"]))).withColumn("score", F.col("score").cast("string"))


def test_names(spark, sf_dir):
    return _of(sources(spark, sf_dir), r"^test_.*\.py$|\.test\.[jt]s$").select("file_id", F.inline(scripts.test_functions(F.col("text"))))


def workspace_references(spark, sf_dir):
    return _of(sources(spark, sf_dir), r"\.env$|^frame\.ts$").select("file_id", F.inline(scripts.references(F.col("text"))))


def manifests(spark, sf_dir):
    return sources(spark, sf_dir).select("file_id", F.inline(scripts.manifest_facts(F.col("name"), F.col("text"))))


def python_sources(spark, sf_dir):
    """Facts and symbols of the Python files; an error's message is left out."""
    f = _of(sources(spark, sf_dir), _PYTHON)
    out = None
    for reader, read in (("fact", parsing.python_facts), ("symbol", parsing.python_symbols)):
        rows = parsing.parse_python(f, "file_id", read=read)
        detail = F.when(F.col("kind") == "error", "").otherwise(F.coalesce("detail", F.lit("")))
        one = rows.select(F.col("path").cast("long").alias("file_id"), F.lit(reader).alias("reader"), "kind", "name", F.col("line").cast("string").alias("line"), detail.alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def synthetic_repositories(spark, sf_dir):
    """Synthetic relationships, and the counts of synthetic repositories of some sizes."""
    r = tables.synthetic_relationships(spark, 3000)
    g = r.groupBy("target_path").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_distinct("route_path").alias("routes"), F.count_distinct("handler").alias("handlers"))
    made = tables.synthetic_counts(F.col("id"))
    sizes = spark.range(50, 3050, 250).select(F.concat(F.lit("files "), F.col("id").cast("string")).alias("target_path"), made["candidates"].alias("n"), made["edges"].alias("high"), made["relationships"].alias("routes"), made["context_tokens"].alias("handlers"))
    return g.unionByName(sizes)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _facts_sql(name: str) -> str:
    index = {t: i for i, (t, _) in enumerate(TEMPLATES)}
    rows = [f"({index[t]}, {', '.join(map(_quoted, fact))})" for t, facts in FACTS[name].items() for fact in facts]
    filled = ", ".join(f"replace(replace(replace({c}, '@A@', a), '@B@', b), '@U@', upper(a[1]) || a[2:]) AS {c}" for c in COLUMNS[name])
    return f"""SELECT k AS file_id, {filled} FROM (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
JOIN (VALUES {", ".join(rows)}) AS f(t, {", ".join(COLUMNS[name])}) ON k % {len(TEMPLATES)} = t"""


SQL = {name: _facts_sql(name) for name in FACTS} | {
    "synthetic_repositories": """WITH r AS (SELECT i, printf('src/target_%03d.py', i % 97) AS target_path, '/route/' || (i % 251) AS route, 'handler_' || (i % 89) AS handler, i % 3 <> 0 AS high FROM range(3000) t(i))
SELECT target_path, count(*) AS n, count(*) FILTER (high) AS high, count(DISTINCT route) AS routes, count(DISTINCT handler) AS handlers FROM r GROUP BY 1
UNION ALL SELECT 'files ' || f, (f + 4) // 5, f - 1 + f // 2, 2 * f + f - 1 + f // 2, 6 * f + 12 * ((f + 4) // 5) FROM range(50, 3050, 250) t(f)""",
}

QUERIES = {f.__name__: f for f in (script_modules, script_symbols, server_routes, go_functions, ui_links, frontend_boundaries, entry_candidates, test_names, workspace_references, manifests, python_sources, synthetic_repositories)}
