"""What a message asks for: files to save, files to edit, and how; and where the paths it names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verbs of creating and editing, words for folders, path tokens, and the modifiers of a save.
CREATE_VERBS = (
    "genera|generar|gener[aá]me|generame|crea|crear|cre[aá]me|creame|hac[eé]|hace|haz|h[aá]zme|hazme|haceme|elabora|elaborar|elab[oó]rame|elaborame|"
    "escribe|escribir|escr[ií]beme|escribeme|redacta|redactar|redact[aá]me|redactame|prepara|preparar|prep[aá]rame|preparame|arma|armar|[aá]rmame|armame|"
    "construye|construir|constr[uú]yeme|construyeme|produce|producir|guarda|guardar|create|generate|make|build|write|draft|produce|prepare|put together|save"
)
EDIT_VERBS = (
    "modifica|modificar|modif[ií]cale|modificale|edita|editar|ed[ií]tale|editale|cambia|cambiar|c[aá]mbiale|cambiale|actualiza|actualizar|actual[ií]zale|actualizale|"
    "corrige|corregir|corr[ií]gele|corrigele|arregla|arreglar|arr[eé]glale|arreglale|repara|reparar|reemplaza|reemplazar|reempl[aá]zale|reemplazale|"
    "ajusta|ajustar|aj[uú]stale|ajustale|revisa|revisar|rev[ií]sale|revisale|agrega|agregar|a[ñn]ade|a[ñn]adir|quita|quitar|elimina|eliminar|borra|borrar|"
    "modify|edit|change|update|fix|correct|repair|replace|adjust|revise|alter|rewrite|refactor"
)
FOLDER = "(?i)\\b(?:el\\s+directorio|la\\s+carpeta|un\\s+directorio|una\\s+carpeta|the\\s+directory|the\\s+folder|directory|folder|carpeta|directorio)\\b\\s+([^\\s,;]+)"
PATH = "(?i)([A-Za-z]:[\\\\/][^\\s,;]+\\.[A-Za-z0-9]{1,6}|[^\\s,;]*/[^\\s,;]+\\.[A-Za-z0-9]{1,6}|[^\\s,;]+\\.[A-Za-z0-9]{1,6})"
CLAUSE_BREAK = "(?i)\\s+(?:y|and)\\s+"
APPEND = "agrega\\w* al final|añad\\w* al final|agregando al final|añadiendo al final|al final del archivo|al final del documento|append\\w*|add(?:ing)? (?:it |this )?to the end"
KEEP = (
    "no\\s+(?:lo\\s+|la\\s+)?sobre?escrib\\w*|no\\s+(?:lo\\s+|la\\s+)?reemplac\\w*|no\\s+(?:lo\\s+|la\\s+)?remplac\\w*|sin\\s+sobre?escribir|"
    "(?:don'?t|do\\s*not)\\s+overwrit\\w*|(?:don'?t|do\\s*not)\\s+replac\\w*|without\\s+overwriting"
)
OVERWRITE = "sobre?escrib\\w*|reemplaz\\w*|remplaz\\w*|overwrit\\w*|replac\\w*"

#: A word's edge by ASCII letters alone, on any Java.
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def whole_words(alternatives: str) -> str:
    return f"(?i)\\b({alternatives})\\b"


def _java(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iu)").replace("\\b", _EDGE)


def clauses(text: Column) -> Column:
    """The parts of a message between ` y ` and ` and `."""
    return F.split(text, _java(CLAUSE_BREAK), -1)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"']+|[\"']+$", "")


def save_intent(text: Column) -> Column:
    """struct<directories, files>: of each clause with a verb of creating, the folder it names, else its first path. Null text has none."""
    acting = F.filter(clauses(F.coalesce(text, F.lit(""))), lambda c: c.rlike(_java(whole_words(CREATE_VERBS))))
    folder, path = _java(FOLDER), _java(PATH)
    dirs = F.transform(F.filter(acting, lambda c: c.rlike(folder)), lambda c: _unquoted(F.regexp_extract(c, folder, 1)))
    files = F.transform(F.filter(acting, lambda c: ~c.rlike(folder) & c.rlike(path)), lambda c: _unquoted(F.regexp_extract(c, path, 1)))
    return F.struct(dirs.alias("directories"), files.alias("files"))


def edit_intent(text: Column) -> Column:
    """struct<asked, files>: whether a clause has a verb of editing, and all paths of such clauses."""
    acting = F.filter(clauses(F.coalesce(text, F.lit(""))), lambda c: c.rlike(_java(whole_words(EDIT_VERBS))))
    files = F.transform(F.flatten(F.transform(acting, lambda c: F.regexp_extract_all(c, F.lit(_java(PATH)), 1))), _unquoted)
    return F.struct((F.size(acting) > 0).alias("asked"), files.alias("files"))


def save_modifiers(text: Column) -> Column:
    """struct<append, overwrite>: overwrite is null if nothing is said; a no wins over a yes."""
    says = lambda p: F.coalesce(text, F.lit("")).rlike(_java(whole_words(p)))
    return F.struct(says(APPEND).alias("append"), F.when(says(KEEP), F.lit(False)).when(says(OVERWRITE), F.lit(True)).alias("overwrite"))


def is_absolute(path: Column) -> Column:
    """A leading slash, a drive letter, or a double backslash."""
    return path.rlike("^(/|[A-Za-z]:[\\\\/]|\\\\\\\\)")


def target_kind(target: Column) -> Column:
    """dir, glob or file."""
    return F.when(target.endswith("/"), "dir").when(target.rlike("[*?]"), "glob").otherwise("file")


def cleaned(path: Column) -> Column:
    """Without empty parts and dots; .. takes its parent away, and at the root nothing."""
    step = lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolved_paths(requests: DataFrame, folders: DataFrame, requested: str = "requested", folder: str = "path", root: str = "") -> DataFrame:
    """requests with resolved, n_matches and error: where a file that a request names is to be.

    Absolute paths stand; a bare name is below root, and so is a path of several
    folders; a single folder is looked up by name among folders: none gives a
    new one below root, one is taken, of more none (error `ambiguous`; the
    folders of that name are a join away). Empty requests and drive letters have
    an error of their own. Folders are counted by name before they are joined.
    """
    name = F.regexp_extract(F.col(folder), "[^/]*$", 0)
    known = folders.select(folder).distinct().groupBy(name.alias("__dir")).agg(F.count("*").alias("n_matches"), F.min(folder).alias("__first"))
    slashed = F.replace(F.col(requested), F.lit("\\"), F.lit("/"))
    out = requests.withColumn("__path", slashed).withColumn("__base", F.regexp_extract("__path", "[^/]*$", 0))
    out = out.withColumn("__parent", F.regexp_replace("__path", "/?[^/]*$", ""))
    single = (F.col("__parent") != "") & ~F.contains("__parent", F.lit("/")) & ~is_absolute(F.col(requested))
    out = out.withColumn("__dir", F.when(single, F.col("__parent"))).join(known, "__dir", "left")
    below = lambda *parts: cleaned(F.concat_ws("/", F.lit(root), *parts) if root else F.concat_ws("/", *parts))
    windows = F.col(requested).rlike("^([A-Za-z]:[\\\\/]|\\\\\\\\)")
    error = F.when(F.coalesce(requested, F.lit("")) == "", "empty").when(windows, "windows path").when(F.col("n_matches") > 1, "ambiguous")
    place = F.when(is_absolute(F.col(requested)), cleaned(F.col("__path"))).when(F.col("n_matches") == 1, cleaned(F.concat_ws("/", "__first", "__base"))).otherwise(below("__path"))
    out = out.withColumn("error", error).withColumn("resolved", F.when(F.col("error").isNull(), place)).withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return out.select(*requests.columns, "resolved", "n_matches", "error")


def allowed_tools(allow: Column, built_in: Column) -> Column:
    """The built-in tools that are allowed, in built-in order; an empty or null list allows all."""
    return F.when(F.coalesce(F.size(allow), F.lit(0)) <= 0, built_in).otherwise(F.filter(built_in, lambda t: F.array_contains(allow, t)))


def markdown_line(line: Column) -> Column:
    """struct<level, runs: array<struct<text, bold>>>: headings of one to three marks (0: none), and the text between pairs of `**`, bold at every second."""
    mark = F.regexp_extract(line, "^(#{1,3}) ", 1)
    body = F.when(mark != "", F.substr(line, F.length(mark) + 2)).otherwise(line)
    runs = F.transform(F.split(body, "\\*\\*", -1), lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("bold")))
    return F.struct(F.length(mark).alias("level"), F.filter(runs, lambda r: r["text"] != "").alias("runs"))
