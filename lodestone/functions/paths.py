"""Column functions over file paths: languages, layers, roles, module candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

# fixed values
EXTENSIONS = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "rust": ("rs",),
    "python": ("py", "pyi"),
}
LANGUAGE_ORDER = ("typescript", "javascript", "rust", "python")
PRUNED_DIRECTORIES = (
    ".git", ".data", ".next", ".turbo", ".venv", ".cache", "node_modules", "target", "dist", "build", "vendor",
    "__pycache__", "coverage", "out",
)
LAYERS = ("api", "services", "repositories", "database", "workers", "components", "hooks", "pages", "external", "other")
LAYER_RULES = (  # in order; segments end at / . - _
    ("pages", r"(?:^|[/.\-_])(?:page|pages)(?=[/.\-_]|\z)|(?:^|/)page\.(?:tsx|jsx|ts)\z"),
    ("api", r"(?:^|[/.\-_])(?:api|handler|handlers|routes|http|controller|controllers)(?=[/.\-_]|\z)"),
    ("services", r"(?:^|[/.\-_])(?:service|services)(?=[/.\-_]|\z)"),
    ("repositories", r"(?:^|[/.\-_])(?:repository|repositories)(?=[/.\-_]|\z)|repository[^/]*\z"),
    ("database", r"(?:^|[/.\-_])(?:db|database|storage)(?=[/.\-_]|\z)"),
    ("workers", r"(?:^|[/.\-_])(?:worker|workers|job|jobs|queue)(?=[/.\-_]|\z)"),
    ("components", r"(?:^|[/.\-_])(?:component|components)(?=[/.\-_]|\z)"),
    ("hooks", r"(?:^|[/.\-_])(?:hook|hooks)(?=[/.\-_]|\z)"),
    ("external", r"(?:^|[/.\-_])(?:client|clients|external|integration|integrations)(?=[/.\-_]|\z)"),
)
GROUPS = {
    "components": "frontend", "hooks": "frontend", "pages": "frontend",
    "api": "backend", "services": "backend", "repositories": "backend",
    "database": "infrastructure", "workers": "infrastructure", "external": "infrastructure",
    "other": "other",
}
GROUP_ORDER = ("frontend", "backend", "infrastructure", "other")
LABELS = {
    "api": "Controllers", "services": "Services", "repositories": "Repositories", "database": "Database", "workers": "Queue",
    "components": "Components", "hooks": "Hooks", "pages": "Pages", "external": "External APIs", "other": "Other",
}
SENSITIVE = (
    r"(?:^|/)(?:\.env|\.env\.[^/]*|[^/]*\.pem|[^/]*\.key|id_rsa|id_ed25519|credentials|credentials\.json|secret\.json)\z"
    r"|(?:^|/)secrets/|/\.git/"
)
TEST = r"/(?:test|tests|__tests__)/|(?:^|/)(?:[^/]*\.(?:test|spec)\.[^/]*|[^/]*_test\.rs|[^/]*_test\.py|test_[^/]*)\z"
ROUTE = (
    r"(?:^|[/.\-_])(?:route|routes|pages|handlers|handler)(?=[/.\-_]|\z)|/api/"
    r"|(?:^|/)(?:page\.tsx|page\.jsx|page\.ts|route\.ts|route\.tsx|layout\.tsx)\z"
)
CANDIDATE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "rs", "py")
INDEX_FILES = ("index.ts", "index.js", "mod.rs", "__init__.py")


def normal(path: Column) -> Column:
    """Forward slashes and ASCII lower case."""
    return ascii_lower(F.translate(path, "\\", "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_segment(path: Column, *needles: str) -> Column:
    """One of the parts between ``/ \\ . - _`` is one of the needles: a single pass over the path."""
    return normal(path).rlike(rf"(?:^|[/.\-_])(?:{'|'.join(needles)})(?=[/.\-_]|\z)")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)\z", 1)


def language(path: Column) -> Column:
    """One of the four languages, or null."""
    ext = ascii_lower(extension(path))
    found = F.lit(None).cast("string")
    for name, exts in EXTENSIONS.items():
        found = F.when(ext.isin(*exts), name).otherwise(found)
    return found


def uses_jsx(path: Column) -> Column:
    return ascii_lower(extension(path)).isin("tsx", "jsx")


def is_sensitive(path: Column) -> Column:
    return normal(path).rlike(SENSITIVE)


def is_test(path: Column) -> Column:
    lowered = normal(path)
    return lowered.rlike(TEST) & ~lowered.contains("/fixtures/")


def is_route(path: Column) -> Column:
    return normal(path).rlike(ROUTE)


def is_component(path: Column, name: Column, kind: Column) -> Column:
    exact = path.rlike(r"(?:^|[/\\.\-_])components?(?=[/\\.\-_]|\z)")
    jsx = path.endswith(".tsx") | path.endswith(".jsx")
    return (kind == "component") | exact | (jsx & name.rlike(r"^\p{Lu}"))


def layer(path: Column) -> Column:
    """Architecture layer by the first rule that holds."""
    found = F.lit("other")
    for name, rule in reversed(LAYER_RULES):
        found = F.when(normal(path).rlike(rule), name).otherwise(found)
    return found


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def layer_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), c).cast("int") - 1


def group_of(c: Column) -> Column:
    return lookup(c, GROUPS)


def group_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GROUP_ORDER)), c).cast("int") - 1


def label_of(c: Column) -> Column:
    return lookup(c, LABELS)


def roles(path: Column, any_component: Column) -> Column:
    """The roles a file plays; ``other`` if none."""
    found = F.array_compact(
        F.array(
            F.when(is_test(path), "test"),
            F.when(is_route(path), "route"),
            F.when(any_component, "component"),
            F.when(layer(path) == "services", "service"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")


def normalize(path: Column) -> Column:
    """``.`` and ``..`` resolved, the root dropped."""

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.when(F.size(done) > 0, shorter).otherwise(done))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_candidates(importer: Column, module: Column) -> Column:
    """The files a relative or rooted module may mean, best first; none for other modules.

    The extension of the module is replaced, not appended.
    """
    folder = F.regexp_replace(importer, r"[^/]*\z", "")
    base = normalize(F.when(module.startswith("/"), module).otherwise(F.concat(folder, module)))
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*\z", "")
    found = F.array(
        *[F.concat(stem, F.lit(f".{e}")) for e in CANDIDATE_EXTENSIONS],
        *[F.concat(base, F.lit(f"/{f}")) for f in INDEX_FILES],
        base,
    )
    usable = module.startswith(".") | module.startswith("/")
    return F.when(usable, found).otherwise(F.array().cast("array<string>"))


def strip_prefix(path: Column, prefix: str) -> Column:
    """The path below a sub-tree; paths outside it stay."""
    if not prefix:
        return path
    head = prefix.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substr(path, F.lit(len(head) + 1))).otherwise(path)


def is_valid_content_path(path: Column) -> Column:
    """Relative, within the tree and not sensitive."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return (path != "") & ~path.startswith("/") & ~F.array_contains(parts, "..") & ~is_sensitive(path)
