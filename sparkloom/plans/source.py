"""Code structure over a small inline source tree, since the driver's tables hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import rules
from sparkloom.operators import graph as G
from sparkloom.operators import lookup as L
from sparkloom.operators import stats as S
from sparkloom.operators import symbols as Y
from sparkloom.plans.base import query

#: (file, language, content)
CODE = [
    ("core/lib.rs", "rust", "use std::fmt;\n\n#[derive(Debug, Clone, Serialize)]\npub struct User {\n    id: u32,\n}\n\npub enum Mode { A, B }\n\npub trait Draw {\n    fn draw(&self);\n}\n\nimpl User {\n    pub fn new() -> Self {\n        helper();\n        User { id: 1 }\n    }\n}\n\nconst LIMIT: u32 = 3;\n\nfn helper() {}\n\nfn main() {\n    User::new();\n    helper();\n}\n"),
    ("web/app.ts", "typescript", "import { Router } from 'express';\nimport x from './local';\n\nexport class UserService {\n  find() { return helper(); }\n}\n\ninterface Shape { a: string }\n\nfunction helper() {\n  const value = 1;\n  return load(value);\n}\n"),
    ("tools/run.py", "python", "from typing import List\nimport os\n\nLIMIT = 3\n\nclass Loader:\n    def load(self):\n        return fetch()\n\ndef fetch():\n    return os.getcwd()\n"),
    ("api/UserController.java", "java", "package api;\n\nimport org.springframework.web.bind.annotation.GetMapping;\n\n@RestController\npublic class UserController {\n    private UserService users;\n\n    @GetMapping\n    public String getUsers() {\n        return findAll();\n    }\n}\n"),
    ("service/UserService.java", "java", "package service;\n\n@Data\n@Service\npublic class UserService {\n    public String findAll() {\n        return query(\"x\");\n    }\n\n    private String query(String q) { return q; }\n}\n"),
    ("cmd/main.go", "go", "package main\n\nimport (\n\t\"fmt\"\n\t\"net/http\"\n)\n\ntype User struct {\n\tName string\n}\n\ntype Logger interface {\n\tLog()\n}\n\nfunc Handler() {\n\thelper()\n}\n\nfunc helper() { fmt.Println() }\n\nfunc (u *User) Start() { Handler() }\n"),
    ("app/Main.kt", "kotlin", "import io.ktor.server\n\ndata class Point(val x: Int)\n\nclass App {\n    fun start() { stop() }\n    private fun stop() {}\n    val name = \"a\"\n}\n"),
    ("src/Api.cs", "csharp", "using System;\n\nnamespace Demo {\n    [ApiController]\n    public class Api {\n        public int Count { get; set; }\n        [HttpGet]\n        public int Find(int id) { return Load(id); }\n        private int Load(int id) { return id; }\n    }\n    public record Pair(int A);\n}\n"),
    ("lib/a.c", "c", "typedef int number;\nstruct node { int v; };\nint add(int a) { return a; }\n"),
    ("lib/a.rb", "ruby", "class Box\n  def open\n  end\nend\n"),
    ("lib/a.php", "php", "class Box {\n  function open() {}\n}\n"),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODE, "file string, language string, content string")


CODE_SQL = "f(file, language, content) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in CODE) + ")"


def _rules_sql(language: str) -> str:
    parts = " UNION ALL ".join(f"SELECT file, '{k}' AS kind, regexp_extract(line, '{p}', 1) AS name, n AS line FROM l" for k, p in rules.SYMBOLS[language])
    return f"WITH {CODE_SQL}, l AS (SELECT file, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(rtrim(content, chr(10)), chr(10))) + 1)) AS n FROM f WHERE language = '{language}') SELECT file, kind, name, line::INT AS line FROM ({parts}) WHERE name <> ''"


def _by_rules(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Y.by_rules(files(spark).where(F.col("language") == language)).select("file", "kind", "name", "line")

    return run


for _language in rules.SYMBOLS:
    query(f"regex_symbols_{_language}", _rules_sql(_language))(_by_rules(_language))


def _records(spark: SparkSession) -> DataFrame:
    return Y.analysed(files(spark))


@query("ast_symbols")
def ast_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.symbols(_records(spark))


@query("ast_calls")
def ast_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark)
    return G.resolved(Y.calls(r), Y.symbols(r))


# The SQL of ast_imports and codegen is a table read off CODE by hand; a plain Python "import x" gives no edge.
@query(
    "ast_imports",
    """SELECT * FROM (VALUES ('core/lib.rs', 'std::fmt', 1), ('web/app.ts', 'express', 1), ('web/app.ts', './local', 2), ('tools/run.py', 'typing', 1),
('api/UserController.java', 'org.springframework.web.bind.annotation.GetMapping', 3), ('cmd/main.go', 'fmt', 4), ('cmd/main.go', 'net/http', 5),
('app/Main.kt', 'io.ktor.server', 1), ('src/Api.cs', 'System', 1)) t(from_file, to_file, line)""",
)
def ast_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.imports(_records(spark))


@query("ast_references")
def ast_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.references(_records(spark))


@query("unused_symbols")
def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark)
    return L.unused(Y.symbols(r), Y.references(r)).select("id", "name", "kind", "file")


@query("flows")
def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark)
    s = Y.symbols(r).withColumn("annotations", F.transform("annotations", lambda a: a["name"]))
    return G.flows(s, G.resolved(Y.calls(r), Y.symbols(r)), rules.ENTRIES, S.layer(F.col("annotations"), F.col("file"), F.col("name")))


@query(
    "codegen",
    """SELECT * FROM (VALUES ('core/lib.rs', 3, 'RustDerive', ['fmt::Debug impl', 'clone()', 'serde::Serialize impl'], '#[derive(Debug, Clone, Serialize)]'),
('service/UserService.java', 3, 'Lombok', ['getters', 'setters', 'equals', 'hashCode', 'toString'], '@Data'),
('app/Main.kt', 3, 'KotlinDataClass', ['equals()', 'hashCode()', 'toString()', 'copy()', 'componentN()'], NULL),
('src/Api.cs', 11, 'CSharpRecord', ['Equals()', 'GetHashCode()', 'ToString()', 'Deconstruct()'], NULL)) t(file, line, pattern_type, members, source_annotation)""",
)
def codegen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.generated(Y.symbols(_records(spark))).unionByName(Y.heads(files(spark)).withColumn("source_annotation", F.lit(None).cast("string")))


@query("frameworks")
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frameworks(files(spark))


@query("code_structure")
def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with their layer and dependencies: the structure view of a whole project."""
    r = _records(spark)
    s = Y.symbols(r).withColumn("layer", S.layer(F.transform("annotations", lambda a: a["name"]), F.col("file"), F.col("name")))
    layers = s.groupBy(F.element_at(F.split("file", "/"), 1).alias("module")).agg(S.module_layer(F.collect_set("layer")).alias("layer"))
    return S.modules(s).join(layers, "module")


@query("symbol_map")
def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.symbol_map(Y.symbols(_records(spark)))


@query("ast_chunks")
def ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.chunks(files(spark))
