"""Schemas of the graph's tables and the fixed values of kinds, weights and word lists."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_STR, _INT, _LONG, _DBL, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
NODES = _s(
    ("id", _STR), ("repo", _STR), ("kind", _STR), ("name", _STR), ("path", _STR), ("start_line", _INT), ("end_line", _INT), ("summary", _STR), ("raw_code", _STR), ("signature", _STR),
    ("docstring", _STR), ("http_method", _STR), ("route_path", _STR), ("last_modified", _TS), ("modification_count", _INT), ("last_retrieved", _TS), ("retrieval_count", _INT), ("seq", _LONG),
)
EDGES = _s(("source", _STR), ("target", _STR), ("kind", _STR), ("weight", _DBL), ("metadata", T.MapType(_STR, _STR)), ("seq", _LONG))
VECTORS = _s(("id", _STR), ("embedding", T.ArrayType(T.FloatType())), ("repo", _STR), ("kind", _STR), ("path", _STR), ("last_modified", _TS), ("http_method", _STR), ("route_path", _STR), ("document", _STR))
SYMBOLS = _s(("repo", _STR), ("path", _STR), ("name", _STR), ("kind", _STR), ("start_line", _INT), ("end_line", _INT), ("code", _STR), ("signature", _STR), ("docstring", _STR), ("decorators", T.ArrayType(_STR)), ("seq", _LONG))
SESSIONS = _s(("session_id", _STR), ("created_at", _TS), ("updated_at", _TS), ("data", _STR))
REPO_STATE = _s(("repo_name", _STR), ("commit", _STR), ("updated_at", _TS))
RULES = _s(("id", _STR), ("type", _STR), ("description", _STR), ("severity", _STR), ("config", T.MapType(_STR, _STR)))

# They must equal the engine's that this one replaces.
NODE_KINDS = ("repository", "module", "file", "class", "function", "method", "type", "constant", "api_endpoint", "config")
SYMBOL_KINDS = ("function", "method", "class", "type", "constant", "api_endpoint")
CONTAINER_KINDS = ("repository", "module", "file")
EDGE_KINDS = ("contains", "calls", "imports", "inherits", "implements", "uses_type", "reads_config", "exposes_api", "api_calls", "shared_lib", "proto_defines")
CROSS_REPO_KINDS = ("api_calls", "shared_lib", "proto_defines")
DEPENDENCY_KINDS = tuple(k for k in EDGE_KINDS if k != "contains")
EDGE_WEIGHTS = {"calls": 1.0, "api_calls": 1.0, "uses_type": 0.8, "reads_config": 0.6, "imports": 0.4, "inherits": 0.9, "implements": 0.9, "contains": 0.3, "exposes_api": 0.7, "shared_lib": 0.5, "proto_defines": 0.5}
STOPWORDS = (
    "the a an is are was were be been do does did has have had in on at to for of with by from and or not it its this that how what where when why who which all each every any my your our "
    "use get set can will should about into out up down code function class method file does work show find"
).split()
THIN_CLASS = "error exception protocol interface base abstract mixin enum kind type result config options params args kwargs meta info status state event signal spec schema dto vo".split()
EXPECTED_EDGES = {"file": ("contains", "imports"), "module": ("contains",)}
QUALITY_WEIGHTS = {"thin": (0.15, 0.35, 0.35, 0.15), "symbol": (0.40, 0.25, 0.20, 0.15), "file": (0.25, 0.20, 0.25, 0.30), "other": (0.25, 0.25, 0.25, 0.25)}
INTENTS = {
    "locate": (r"\bwhere\b", r"\bfind\b", r"\blocate\b", r"\bwhich file\b", r"\bwhat file\b", r"\bdefined\b", r"\blives?\b", r"\blocation\b"),
    "trace": (r"\bhow does\b", r"\bflow\b", r"\btrace\b", r"\bcall.?chain\b", r"\bwhat happens when\b", r"\bstep.?by.?step\b", r"\bsequence\b", r"\bpipeline\b"),
    "write": (r"\badd\b", r"\bcreate\b", r"\bimplement\b", r"\bwrite\b", r"\bbuild\b", r"\bnew\b", r"\bextend\b", r"\brefactor\b"),
    "debug": (r"\bwhy\b", r"\bcrash", r"\berror\b", r"\bbug\b", r"\bfail", r"\bfix\b", r"\bbroken\b", r"\bwrong\b", r"\bdebug\b"),
}
#: intent -> (share of the vector score, hops, relevance gate)
PROFILES = {"locate": (0.4, 1, 0.35), "trace": (0.7, 3, 0.25), "write": (0.6, 2, 0.3), "debug": (0.5, 2, 0.3), "general": (0.7, 2, 0.3)}
FRAMEWORKS = {
    "flask": "Flask", "fastapi": "FastAPI", "django": "Django", "aiohttp": "aiohttp", "starlette": "Starlette", "tornado": "Tornado", "express": "Express.js", "koa": "Koa", "nestjs": "NestJS", "react": "React",
    "nextjs": "Next.js", "vue": "Vue", "angular": "Angular", "svelte": "Svelte", "spring": "Spring", "quarkus": "Quarkus", "gin": "Gin", "fiber": "Fiber", "echo": "Echo", "actix": "Actix", "axum": "Axum",
    "rocket": "Rocket", "rails": "Rails", "sinatra": "Sinatra", "vapor": "Vapor", "sqlalchemy": "SQLAlchemy", "prisma": "Prisma", "sequelize": "Sequelize", "celery": "Celery", "pytest": "pytest", "junit": "JUnit",
}
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".cs": "c_sharp", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".lua": "lua", ".php": "php",
    ".scala": "scala", ".zig": "zig", ".ex": "elixir", ".exs": "elixir", ".hs": "haskell", ".ml": "ocaml", ".mli": "ocaml", ".r": "r", ".dart": "dart", ".v": "v", ".jl": "julia",
}
KEYWORDS = (
    "if else elif for while do switch case break continue return try catch except finally throw throws raise with as is in not and or true false True False nil null None self this super var let val const static final "
    "def func fun fn function async await yield class struct enum protocol interface trait impl import from package module use using include public private protected internal open fileprivate override abstract virtual "
    "sealed new delete void int str string bool float double char print println printf guard where some any get set init deinit map filter reduce rethrows mutating nonmutating lazy weak unowned required optional "
    "convenience inout typealias"
).split()
REQUIRED_CONFIG = {"dependency_ban": ("source_pattern", "target_pattern"), "cycle_detection": ("scope",), "metric_threshold": ("metric", "threshold"), "impact_threshold": ("max_impact",), "file_scope_ban": ("path_pattern",)}
# How a parser's node types are classed.
DECLARATION_ENDS = ("_declaration", "_definition", "_item")
NO_SYMBOLS = (
    "expression_statement assignment variable_declaration lexical_declaration short_var_declaration const_declaration let_declaration var_declaration field_declaration parameter parameter_declaration "
    "argument_list import_declaration import_statement include_statement package_declaration comment line_comment block_comment ERROR"
).split()
FUNCTION_HINTS = ("function", "method", "func", "constructor", "initializer")
CLASS_HINTS = ("class", "struct", "enum", "protocol", "interface", "trait", "impl", "type", "module", "namespace", "object")
# Words before and of a declaration where no parser knows the language, and the most lines that it may take.
FUNCTION_WORDS = ("func", "def", "fn", "fun", "function")
TYPE_WORDS = ("class", "struct", "enum", "protocol", "interface", "trait", "object")
FUNCTION_MODIFIERS = ("pub", "public", "priv", "private", "prot", "protected", "internal", "open", "fileprivate", "static", "async", "override", "final", "abstract", "virtual")
TYPE_MODIFIERS = ("pub", "public", "priv", "private", "prot", "protected", "internal", "open", "fileprivate", "static", "final", "abstract", "sealed")
LONGEST_DECLARATION = 200
# A word of a text, an HTTP request in a question, and the forms in which a signature names its bases.
TEXT_WORD = "[a-zA-Z_][a-zA-Z0-9_]{2,}"
REQUEST = r"(?:\b(GET|POST|PUT|DELETE|PATCH)\s+)?(/\S*)"
BASES = (
    "\\(\\s*([^)]+)\\)", "(?:class|struct|enum|protocol|interface)\\s+\\w+\\s*:\\s*(.+?)(?:\\{|where|$)",
    "extends\\s+([\\w,\\s<>]+?)(?:\\{|implements|$)", "implements\\s+([\\w,\\s<>]+?)(?:\\{|implements|$)",
)
SEVERITIES = ("info", "warning", "block")
METRICS = ("afferent_coupling", "efferent_coupling", "instability")
