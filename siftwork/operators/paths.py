"""Paths: which are skipped, what type they are, and how their names are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.config import Config

# Extensions of each file type.
EXTENSIONS = {
    "Log": "log",
    "Json": "json",
    "Text": "txt",
    "Markdown": "md markdown",
    "Image": "jpg jpeg png gif bmp tiff tif webp ico svg",
    "Video": "mp4 mkv avi mov wmv flv webm m4v 3gp ogv",
    "Audio": "mp3 flac wav m4a aac ogg opus wma ape dsd dsf aif aiff aifc",
    "Csv": "csv tsv tab psv",
    "Parquet": "parquet",
    "ArrowIpc": "arrow feather ipc",
    "Avro": "avro",
    "Orc": "orc",
    "Npy": "npy",
    "Npz": "npz",
    "Hdf5": "h5 hdf5",
    "NetCdf": "nc cdf",
    "Mtx": "mtx",
    "Mat": "mat",
    "Onnx": "onnx",
    "Gguf": "gguf",
    "Tflite": "tflite",
    "Safetensors": "safetensors",
    "Zarr": "zarr",
    "Tetration": "tet",
    "Pickle": "pickle",
    "Html": "html htm",
    "Docx": "docx",
    "Xlsx": "xlsx",
    "Pptx": "pptx",
    "Sqlite": "db sqlite sqlite3",
    "Toml": "toml lock",
    "Ini": "ini cfg",
    "Xml": "xml",
    "Yaml": "yaml yml",
    "Zip": "zip",
    "Archive": "tar gz bz2 xz tgz",
    "Epub": "epub",
    "Pdf": "pdf",
}
#: Types told by what the file holds or by a language table, not by the map above.
OTHER_TYPES = ("Code", "Unknown")
TYPE_OF = {e: t for t, es in EXTENSIONS.items() for e in es.split()}
# How source code is told by its extension or its whole name.
LANGUAGES = {
    "python": "py pyw pyi", "rust": "rs", "javascript": "js mjs cjs jsx", "typescript": "ts tsx", "go": "go", "c": "c h", "c++": "cpp cc cxx hpp hh", "c#": "cs", "java": "java", "kotlin": "kt kts",
    "scala": "scala sc", "ruby": "rb", "php": "php", "perl": "pl pm", "shell": "sh bash zsh", "powershell": "ps1", "sql": "sql", "r": "r", "swift": "swift", "lua": "lua", "haskell": "hs",
    "ocaml": "ml mli", "elixir": "ex exs", "erlang": "erl hrl", "clojure": "clj cljs", "dart": "dart", "julia": "jl", "css": "css", "scss": "scss", "pkl": "pkl", "protocol buffer": "proto",
}
LANGUAGE_OF = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}
# Whole names of source files.
NAMED = {"makefile": "makefile", "dockerfile": "dockerfile", "rakefile": "ruby", "gemfile": "ruby", "cmakelists.txt": "cmake", "jenkinsfile": "groovy"}
COMPOUND = (".tar.gz", ".tar.bz2", ".tar.xz", ".tgz")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def is_ignored(path: Column, config: Config = Config()) -> Column:
    """Hidden files, exact names in any case, and names that match *suffix or prefix*."""
    name = base_name(path)
    tests = [name.startswith(".")] if config.ignore_hidden_files else []
    for p in config.ignore_patterns:
        tests.append(name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else F.lower(name) == p.lower())
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def inside_store(path: Column) -> Column:
    """Whether a path lies inside an array store, whose root stands for it."""
    return path.contains(".zarr") & ~F.rtrim(F.regexp_replace(path, r"[/\\]+$", "")).endswith(".zarr")


def extension(path: Column) -> Column:
    """The part of the name behind its last full stop, in lower case; empty where the name has none or only begins with one."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# Words that open a source file which shares its extension with serialised objects.
SOURCE_WORDS = ("module", "import ", "amends ", "extends ", "local ", "const ", "fixed ", "abstract ", "open ", "class ", "typealias ", "@")


def is_pickle(content: Column) -> Column:
    """Whether the first 4,096 bytes look like serialised objects: a protocol mark of 2 to 5, bytes that aren't UTF-8, or text
    that opens as a protocol of text does or holds a zero byte, and isn't source text. Null and empty contents don't."""
    head = F.substring(content, 1, 4096)
    mark = F.hex(F.substring(head, 1, 2)).isin("8002", "8003", "8004", "8005")
    text = F.ltrim(F.regexp_replace(F.try_validate_utf8(head.cast("string")), r"(?U)^\s+", ""))
    source = reduce(lambda a, b: a | b, [text.startswith(w) for w in SOURCE_WORDS])
    opens = F.substring(text, 1, 1).isin("(", "]", "}", ".")
    told = F.when(F.octet_length(head) == 0, False).when(mark | text.isNull(), True).otherwise(~source & (opens | text.contains("\0")))
    return F.coalesce(F.when(content.isNotNull(), told), F.lit(False))


def file_type(path: Column, content: Column | None = None) -> Column:
    """Type by the name: compound archive endings, then the extension in any case; Unknown otherwise.

    With the content, as for files that exist, .pkl is looked at (`is_pickle`), and source code is told by its extension or
    its whole name.
    """
    ext = extension(path)
    archive = reduce(lambda a, b: a | b, [F.lower(path).endswith(c) for c in COMPOUND])
    by_name = F.try_element_at(_literal_map(TYPE_OF), ext)
    out = F.when(archive, "Archive")
    if content is not None:
        code = F.try_element_at(_literal_map(LANGUAGE_OF), ext).isNotNull() | F.lower(base_name(path)).isin(*NAMED)
        out = out.when((ext == "pkl") & is_pickle(content), "Pickle").when(by_name.isNull() & code, "Code")
    return out.otherwise(F.coalesce(by_name, F.lit("Unknown")))


def extensions_of(kind: str) -> list[str]:
    """The extensions of a type, in the order of its list; none for a type that has none or isn't known."""
    return EXTENSIONS.get(kind, "").split()


def is_codec_of(codec: Column, kind: str) -> Column:
    """Whether the name of a codec contains an extension of the type, in any case; null for a null name."""
    return reduce(lambda a, b: a | b, [F.lower(codec).contains(e) for e in extensions_of(kind)], F.lit(False))


# Labels of the types in results.
LABELS = {
    "Log": "Log", "Json": "JSON", "Text": "Text", "Markdown": "Markdown", "Image": "Image", "Video": "Video", "Audio": "Audio", "Csv": "CSV", "Pdf": "PDF", "Docx": "DOCX",
    "Xlsx": "XLSX", "Sqlite": "SQLite", "Toml": "TOML", "Zip": "ZIP", "Xml": "XML", "Html": "HTML", "Yaml": "YAML", "Ini": "INI", "Pptx": "PPTX", "Epub": "EPUB",
    "Archive": "Archive", "Code": "Code", "Parquet": "Parquet", "ArrowIpc": "Arrow IPC", "Avro": "Avro", "Orc": "ORC", "Npy": "NPY", "Npz": "NPZ", "Hdf5": "HDF5", "NetCdf": "NetCDF",
    "Mtx": "Matrix Market", "Mat": "MATLAB MAT", "Onnx": "ONNX", "Gguf": "GGUF", "Tflite": "TFLite", "Safetensors": "Safetensors", "Zarr": "Zarr", "Tetration": "Tetration",
    "Pickle": "Pickle", "Unknown": "Unknown",
}


def label(kind: Column) -> Column:
    """The label of a type in results; null for a name that is no type."""
    return F.try_element_at(_literal_map(LABELS), kind)


def labelled(label_: Column) -> Column:
    """The type that a label names, exactly as it is spelt; null for any other text."""
    return F.try_element_at(_literal_map({v: k for k, v in LABELS.items()}), label_)


def normalised(paths) -> list[str]:
    """A path, or any iterable of paths, as a list of texts; a path object gives its text."""
    return [str(paths)] if isinstance(paths, str) or hasattr(paths, "__fspath__") else [str(p) for p in paths]


def redacted(path: Column) -> Column:
    """Only the last part of the path."""
    return F.concat(F.lit("***/"), base_name(path))


def sanitised(name: Column) -> Column:
    """Brackets become _; blanks, line breaks, apostrophes and commas are dropped."""
    return F.translate(name, "{}[]() \t\n\r',", "______")


def human_bytes(n: Column) -> Column:
    """1.50 KB and the like, in steps of 1024; bytes without digits."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.format_string("%.2f PB", n / 1024.0**5)
    for k in range(4, 0, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {units[k]}", n / float(1024**k))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def human_duration(seconds: Column) -> Column:
    """Microseconds, milliseconds, seconds or minutes with two digits."""
    s = seconds.cast("double")
    out = F.when(s < 60, F.format_string("%.2f s", s)).otherwise(F.format_string("%.2f m", s / 60.0))
    return F.when(s < 0.001, F.format_string("%.2f μs", s * 1e6)).when(s < 1, F.format_string("%.2f ms", s * 1e3)).otherwise(out)


def scan(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Paths, sizes and contents (as the binaryFile reader gives them) with type, text test, line and token counts.

    Ignored paths and the insides of array stores are left out. Content that isn't valid UTF-8 is binary, without counts.
    """
    body = F.col("content").cast("string")
    text = F.is_valid_utf8(body)
    last = F.when(F.octet_length(body) == 0, 0).otherwise(F.regexp_count(body, F.lit("\n")) + F.when(body.endswith("\n"), 0).otherwise(1))
    return files.where(~is_ignored(F.col("path"), config) & ~inside_store(F.col("path"))).select(
        "path",
        file_type(F.col("path"), F.col("content")).alias("file_type"),
        F.col("length").alias("byte_count"),
        (~text).alias("is_binary"),
        F.when(text, last).otherwise(0).cast("bigint").alias("line_count"),
        F.when(text, F.floor(F.col("length") / 4)).otherwise(0).cast("bigint").alias("token_count"),
        "content",
    )


def adaptive_chunking(files: DataFrame, size: str, keys: list[str], kind: str = "file_type", config: Config = Config()) -> DataFrame:
    """Mean (whole bytes) and coefficient of variation of file sizes, and how many chunks a worker they suggest.

    One file, or only images and audio: 1. Otherwise by the mean: small 1, medium 2, large 3; one less (1 at least) where
    sizes vary by more than half of their mean. Null sizes don't count.
    """
    mean, cv = F.col("mean_bytes"), F.col("cv")
    own = files.where(F.col(size).isNotNull())
    media = F.bool_and(F.coalesce(F.col(kind).isin("Image", "Audio"), F.lit(False)))
    out = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"), F.floor(F.sum(size) / F.count(F.lit(1))).cast("bigint").alias("mean_bytes"), F.stddev_pop(size).alias("dev"), F.avg(size).alias("exact"), media.alias("media"))
    # the deviation is around the whole mean
    around = F.sqrt(F.pow(F.col("dev"), 2) + F.pow(F.col("exact") - mean, 2))
    out = out.withColumn("cv", F.when(mean > 0, around / mean).otherwise(0.0))
    varied = (cv > 0.5).cast("int")
    factor = F.when((F.col("file_count") == 1) | F.col("media") | (mean < config.small_file_threshold_bytes), 1).when(mean < config.large_file_threshold_bytes, 2 - varied).otherwise(3 - varied)
    return out.withColumn("multiplier", factor).drop("dev", "exact", "media")
