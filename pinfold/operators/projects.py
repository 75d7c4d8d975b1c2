"""What a project pins, from its build files; many projects at once, each a set of files (project, path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinfold.functions import versions as V

# How the build files name the plugin and the version, and the files by precedence.
PLUGIN = r"""id\s*\(?\s*["'](?:edu\.wpi\.first|org\.wpilib)\.GradleRIO["']\s*\)?"""
VERSION = r"""\s*version\s*["']([^"']+)["']"""
PROPERTY = r"(?m)^\s*(?:wpilibVersion|gradleRioVersion|gradlerioVersion)\s*=\s*([0-9][\w.\-]*)\s*$"
PYTHON = r"""(?m)^\s*robotpy_version\s*=\s*["']([^"']+)["']"""
BUILDS, SETTINGS = ("build.gradle", "build.gradle.kts"), ("settings.gradle", "settings.gradle.kts")
#: Folder of the installed catalog files.
FOLDER = "vendordeps/"


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def detect(files: DataFrame) -> DataFrame:
    """(project, version, season, channel, language, installed, warnings) of every project that has a build file.

    The first build file counts; a plugin without a version there takes it from the properties, else from the settings; a
    Python project file wins over both. ``installed`` are the catalog files, name and version each, in the order of their
    paths; a warning names a build file without the plugin or a version, a catalog file that is no JSON, and one of
    another year than the project's. A file given twice counts once; null texts are empty.
    """
    f = files.groupBy("project", "path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).filter("project IS NOT NULL AND path IS NOT NULL")
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("text")))
    named = [*BUILDS, *SETTINGS, "gradle.properties", "pyproject.toml"]
    json = F.from_json("text", "name string, version string, frcYear string, wpilibYear string")
    broken = F.try_variant_get(F.try_parse_json("text"), "$", "string").isNull()
    item = F.struct("path", broken.alias("broken"), json["name"].alias("name"), json["version"].alias("version"), F.coalesce(json["frcYear"], json["wpilibYear"], F.lit("")).alias("year"))
    installed = (F.col("path").startswith(FOLDER)) & F.col("path").endswith(".json") & ~F.substring("path", len(FOLDER) + 1, 2**31 - 1).contains("/")
    each = f.groupBy("project").agg(
        *[at(p).alias(p) for p in named], F.max(F.col("path").rlike("^src/main/(cpp|include)(/|$)")).alias("native"), F.array_sort(F.collect_list(F.when(installed, item))).alias("deps")
    )  # a project's own files
    col = lambda p: F.col(f"`{p}`")
    build = F.coalesce(*[col(p) for p in BUILDS])
    which = F.when(col(BUILDS[0]).isNotNull(), BUILDS[0]).otherwise(BUILDS[1])
    plugin = F.coalesce(build.rlike(PLUGIN), F.lit(False))
    inside = lambda c: _some(F.regexp_extract(c, PLUGIN + VERSION, 1))
    gradle = F.when(plugin, F.coalesce(inside(build), _some(F.regexp_extract(col("gradle.properties"), PROPERTY, 1)), *[inside(col(p)) for p in SETTINGS]))
    python = _some(F.regexp_extract(col("pyproject.toml"), PYTHON, 1))
    version = F.coalesce(python, gradle, F.lit(""))
    rows = each.filter(build.isNotNull() | python.isNotNull()).select(
        "project", version.alias("version"), F.regexp_extract(version, "^(20[23][0-9])", 1).alias("season"),
        F.when(F.lower(version).contains("alpha"), "alpha").when(F.lower(version).contains("beta"), "beta").when(version != "", "stable").otherwise("").alias("channel"),
        F.when(python.isNotNull(), "python").when(F.col("native"), "cpp").otherwise("java").alias("language"), "deps",
        F.when(build.isNotNull() & ~plugin, F.concat(which, F.lit(": plugin not found"))).when(build.isNotNull() & gradle.isNull(), F.concat(which, F.lit(": version not found"))).alias("lacks"),
    )

    def warning(d: Column) -> Column:
        declared = V.declared_season(d["year"])
        other = (F.col("season") != "") & (declared != "") & (declared != F.col("season"))
        return F.when(d["broken"], F.concat(d["path"], F.lit(": invalid JSON"))).when(other, F.concat(d["path"], F.lit(": declares "), d["year"]))

    warnings = F.array_compact(F.concat(F.array("lacks"), F.transform("deps", warning)))
    kept = F.transform(F.filter("deps", lambda d: ~d["broken"]), lambda d: F.concat_ws(" ", d["name"], d["version"]))
    return rows.select("project", "version", "season", "channel", "language", kept.alias("installed"), warnings.alias("warnings"))
