"""Readers and writers of the record files. Sentinels become NULL here and nowhere else.

Line formats are plain text scans, pruned and split by Spark. Formats whose records span lines are read
one file a row and parsed in Arrow batches; many files make many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistrack.session import join_checked, stored


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))


def _columns(lines: DataFrame, spec: str) -> DataFrame:
    cols = [c.strip().split() for c in spec.split(",")]
    return lines.select(*[F.get("p", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(cols)])


def numbered_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(id, value): line number from 0. A list file is one file of one line an image, read as a whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("id", name))


def images(spark: SparkSession, names: str, dims: str) -> DataFrame:
    """(image_id, name, width, height) from two files joined by line position."""
    d = numbered_lines(spark, dims, "d").select("id", F.split(F.trim("d"), r"\s+").alias("d"))
    return numbered_lines(spark, names, "name").join(d, "id", "left").select(F.col("id").alias("image_id"), F.trim("name").alias("name"), F.get("d", F.lit(0)).cast("int").alias("width"), F.get("d", F.lit(1)).cast("int").alias("height"))


def key_list(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, "key_path").withColumnRenamed("id", "image_id")


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, "n").select(F.col("id").alias("image_id"), F.trim("n").cast("int").alias("n"))


def counts_for(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Feature count of each image, -1 out of range."""
    return images.join(counts, "image_id", "left").select("image_id", F.coalesce("n", F.lit(-1)).alias("n"))


def image_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, name, fisheye, init_focal) from lines: path [fisheye [focal]]."""
    p = numbered_lines(spark, path, "v").select("id", F.split(F.trim("v"), r"\s+").alias("p"))
    return p.select(F.col("id").alias("image_id"), F.get("p", F.lit(0)).alias("name"), (F.coalesce(F.get("p", F.lit(1)).try_cast("int"), F.lit(0)) != 0).alias("fisheye"), F.get("p", F.lit(2)).try_cast("double").alias("init_focal"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_lines(spark, path), "a int, b int")


def pairs_with_f(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.get("p", F.lit(0)).cast("int").alias("a"), F.get("p", F.lit(1)).cast("int").alias("b"), F.slice("p", 3, 9).cast("array<double>").alias("f"))


def ranks(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_lines(spark, path), "src int, dst int, n int")


def queries(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_lines(spark, path), "image_id int, key_path string")


def ids(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_lines(spark, path), "image_id int")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, name); -1 and notfound are NULL."""
    m = _columns(_lines(spark, path), "src int, dst int, name string")
    return m.select("src", F.nullif("dst", F.lit(-1)).alias("dst"), F.when(F.col("dst") != -1, F.col("name")).alias("name"))


def matches(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_lines(spark, path), "a int, ka int, xa double, ya double, b int, kb int, xb double, yb double")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, n) of the non-zero cells of a dense matrix, one line a row."""
    rows = numbered_lines(spark, path, "v").select(F.col("id").alias("a"), F.posexplode(F.split(F.trim("v"), r"\s+")).alias("b", "n"))
    return rows.select("a", "b", F.col("n").cast("long").alias("n")).where("n <> 0")


def tracks(spark: SparkSession, path: str, xyz: bool = False) -> DataFrame:
    """(obs array of view, key, x, y[, pos]) from lines: n (view key x y) x n [X Y Z]."""
    n = F.get("p", F.lit(0)).cast("int")
    at = lambda i, k: F.get("p", 1 + 4 * i + k)
    obs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).cast("int").alias("view"), at(i, 1).cast("int").alias("key"), at(i, 2).cast("double").alias("x"), at(i, 3).cast("double").alias("y")))
    cols = [F.when(n > 0, obs).otherwise(F.array().cast("array<struct<view:int,key:int,x:double,y:double>>")).alias("obs")]
    return _lines(spark, path).select(*cols, *([F.slice("p", n * 4 + 2, 3).cast("array<double>").alias("pos")] if xyz else []))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _text(content: bytes) -> str:
    import gzip

    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode()


def match_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, ka, kb) from blocks: a line with the pair, one with the count, then the rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for content in b.column(1):
                v, i = list(map(int, _text(content.as_py()).split())), 0
                while i < len(v):
                    n = v[i + 2]
                    rows += [(v[i], v[i + 1], v[j], v[j + 1]) for j in range(i + 3, i + 3 + 2 * n, 2)]
                    i += 3 + 2 * n
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()) for c in cols], names=["a", "b", "ka", "kb"])

    return _whole(spark, path).mapInArrow(run, "a int, b int, ka int, kb int")


def key_files(spark: SparkSession, path: str, header_only: bool = False) -> DataFrame:
    """Keypoint files, plain or gzip: (path, key, x, y, scale, orient, desc), or (path, n) from headers.

    The file has y before x; descriptors have 128 values from 0 to 255 on any number of lines.
    """

    def heads(batches):
        import pyarrow as pa

        for b in batches:
            n = [int(_text(c.as_py()).split(None, 2)[0]) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["path", "n"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                v = _text(content.as_py()).split()
                n, dim = int(v[0]), int(v[1])
                if dim != 128 or len(v) != 2 + n * 132:
                    raise ValueError(f"{name}: {n} keys of {dim} values in {len(v)} fields")
                m = np.array(v[2:], dtype=float).reshape(n, 132)
                f = lambda i: pa.array(m[:, i].astype(np.float32))  # noqa: B023, E731
                desc = pa.array([r.tobytes() for r in m[:, 4:].astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), f(1), f(0), f(2), f(3), desc], names=["path", "key", "x", "y", "scale", "orient", "desc"])

    whole = _whole(spark, path)
    return whole.mapInArrow(heads, "path string, n long") if header_only else whole.mapInArrow(run, "path string, key int, x float, y float, scale float, orient float, desc binary")


MODEL = "kind string, id long, f double, k1 double, k2 double, r array<double>, t array<double>, valid boolean, pos array<double>, rgb array<int>, obs array<struct<view:int,key:int,x:double,y:double>>"


def ordered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(no, value) of the lines of a file, or of the files of a folder in name order as one, and their number. Blank
    lines and those that start with # are left out. A file is read in as many tasks as it has blocks; only one row a
    block is gathered, to tell where its lines begin."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    kept = spark.read.text(path).select("value", *at).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    lines = kept.withColumn("at", F.monotonically_increasing_id())
    w = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = stored(blocks.withColumn("start", F.sum("n").over(w) - F.col("n")), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    return join_checked(lines, blocks, ["file", "block"], "inner").select((F.col("start") + F.col("at") - F.col("first")).alias("no"), "value"), total


def _numbers(c, kind: str = "double"):
    return F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.cast(kind))


def _records(lines: DataFrame, first: int, last: int, size: int) -> DataFrame:
    """(id, l0, l1, ...) of records of ``size`` lines that stand in the lines first to last - 1."""
    own = lines.where(F.col("no").between(first, last - 1)).withColumn("k", F.col("no") - first)
    return own.groupBy(F.expr(f"k div {size}").alias("id")).agg(*[F.max(F.when(F.col("k") % size == i, F.col("value"))).alias(f"l{i}") for i in range(size)])


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cameras (view, f, k1, k2, r, t, valid), points (point, pos, rgb, n_vis), observations (point, pos,
    view, key, x, y) of a model: a file, or a folder of parts in name order as write_model leaves it. Header lines
    start with # and are optional; a camera of zeros is not valid and has NULL fields; colors become shares of 255.

    Files whose records stand in lines of their own (five a camera, three a point), as usual, are read in blocks, and of
    a section only its own lines: observations need no shuffle at all. Files with other line ends are read whole, one
    file a task (free_model)."""
    lines, total = ordered_lines(spark, path)
    head = lines.where("no = 0").first()
    counts = [int(x) for x in head["value"].split()] if head and re.fullmatch(r"\s*\d+\s+\d+\s*", head["value"]) else None
    if not counts or total != 1 + 5 * counts[0] + 3 * counts[1]:
        return free_model(spark, path)
    base = 1 + 5 * counts[0]
    c = _records(lines, 1, base, 5)
    f, r, t = _numbers("l0"), F.concat(*[_numbers(f"l{i}") for i in (1, 2, 3)]), _numbers("l4")
    valid = F.exists(r, lambda x: x != 0)
    mine = lambda v, name: F.when(valid, v).alias(name)
    cameras = c.select(F.col("id").alias("view"), *[mine(F.get(f, F.lit(i)), n) for i, n in enumerate(("f", "k1", "k2"))], mine(r, "r"), mine(t, "t"), valid.alias("valid"))
    p = _records(lines, base, total, 3)
    points = p.select(F.col("id").alias("point"), _numbers("l0").alias("pos"), F.transform(_numbers("l1", "int"), lambda x: x / 255.0).alias("rgb"), F.get(F.split(F.trim("l2"), r"\s+"), F.lit(0)).cast("int").alias("n_vis"))
    seen = lines.where((F.col("no") >= base) & ((F.col("no") - base) % 3 == 2)).select(F.expr(f"(no - {base}) div 3").alias("point"), F.split(F.trim("value"), r"\s+").alias("v"))
    n = F.get("v", F.lit(0)).try_cast("int")  # the filter may come to see lines of other sections
    at = F.sequence(F.lit(0), n - 1)
    seen = seen.where(n > 0).select("point", "v", F.explode(at).alias("pos"))
    part = lambda i, kind: F.get("v", 1 + 4 * F.col("pos") + i).cast(kind)
    obs = seen.select("point", "pos", part(0, "int").alias("view"), part(1, "int").alias("key"), part(2, "double").alias("x"), part(3, "double").alias("y"))
    return cameras, points, obs


def free_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """model() of files in which values are parted by any white space; each file is a model, read by one task."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(1):
                lines = [x for x in _text(content.as_py()).split("\n") if x.strip() and not x.startswith("#")]
                v, i, rows = " ".join(lines).split(), 2, []
                n_cam, n_pt = int(v[0]), int(v[1])
                for c in range(n_cam):
                    x = list(map(float, v[i : i + 15]))
                    i += 15
                    ok = any(x[3:12])
                    rows.append({"kind": "c", "id": c, "valid": ok, **({"f": x[0], "k1": x[1], "k2": x[2], "r": x[3:12], "t": x[12:]} if ok else {})})
                for p in range(n_pt):
                    pos, rgb, n = list(map(float, v[i : i + 3])), list(map(int, v[i + 3 : i + 6])), int(v[i + 6])
                    i += 7
                    obs = [{"view": int(v[j]), "key": int(v[j + 1]), "x": float(v[j + 2]), "y": float(v[j + 3])} for j in range(i, i + 4 * n, 4)]
                    i += 4 * n
                    rows.append({"kind": "p", "id": p, "pos": pos, "rgb": rgb, "obs": obs})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    import pyarrow as pa

    ob = pa.struct([("view", pa.int32()), ("key", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
    shape = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("f", pa.float64()), ("k1", pa.float64()), ("k2", pa.float64()), ("r", pa.list_(pa.float64())), ("t", pa.list_(pa.float64())), ("valid", pa.bool_()), ("pos", pa.list_(pa.float64())), ("rgb", pa.list_(pa.int32())), ("obs", pa.list_(ob))])
    rows = _whole(spark, path).mapInArrow(run, MODEL)
    cameras = rows.where("kind = 'c'").select(F.col("id").alias("view"), "f", "k1", "k2", "r", "t", "valid")
    pts = rows.where("kind = 'p'")
    points = pts.select(F.col("id").alias("point"), "pos", F.transform("rgb", lambda x: x / 255.0).alias("rgb"), F.size("obs").alias("n_vis"))
    obs = pts.select(F.col("id").alias("point"), F.posexplode("obs").alias("pos", "o")).select("point", "pos", "o.*")
    return cameras, points, obs


def pose_files(spark: SparkSession, path: str) -> DataFrame:
    """Pose parameter files: (path, corr array of (key, point), p, k, r, c): the number of correspondences and
    their lines, then P (3 x 4), K, R (3 x 3) and the center, by blanks and line ends."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for name, content in zip(b.column(0), b.column(1), strict=True):
                v = _text(content.as_py()).split()
                n = int(v[0])
                corr = [{"key": int(v[i]), "point": int(v[i + 1])} for i in range(1, 1 + 2 * n, 2)]
                x = list(map(float, v[1 + 2 * n :]))
                if len(x) != 33:
                    raise ValueError(f"{name}: {len(x)} numbers after {n} correspondences, not 33")
                rows.append({"path": name.as_py(), "corr": corr, "p": x[:12], "k": x[12:21], "r": x[21:30], "c": x[30:]})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    import pyarrow as pa

    numbers = pa.list_(pa.float64())
    shape = pa.schema([("path", pa.string()), ("corr", pa.list_(pa.struct([("key", pa.int32()), ("point", pa.int32())]))), *((c, numbers) for c in "pkrc")])
    return _whole(spark, path).mapInArrow(run, "path string, corr array<struct<key:int,point:int>>, p array<double>, k array<double>, r array<double>, c array<double>")


def image_number(path) -> F:
    """The image id in a file name of four or more digits and a dash, as 0012-cam.txt."""
    return F.regexp_extract(path, r"(\d{4,})-[^/]*$", 1).cast("long")


def camera_files(spark: SparkSession, path: str) -> DataFrame:
    """One camera a file: (view, f, k1, k2, r, t), the view from the file's name."""
    v = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = spark.read.text(path, wholetext=True).select(image_number(F.col("_metadata.file_path")).alias("view"), v.alias("v"))
    return rows.select("view", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("f", "k1", "k2"))], F.slice("v", 4, 9).alias("r"), F.slice("v", 13, 3).alias("t"))


def correspondence_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of point, view, key, x, y."""
    v = F.split(F.trim("value"), r"\s+")
    kinds = (("point", "long"), ("view", "long"), ("key", "long"), ("x", "double"), ("y", "double"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*[F.get(v, F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(kinds)])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Centers of a vocabulary, one line each, by order: (word, v). Words are numbered over all files in name order."""
    from vistrack.plans.ranking import global_rank

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where(F.length(F.trim("value")) > 0)
    ranked, _ = global_rank(lines, "file", "block", "at", name="word")
    return ranked.select((F.col("word") - 1).alias("word"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("v"))


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Lines of image, key, word."""
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*[F.get(v, F.lit(i)).cast("long").alias(c) for i, c in enumerate(("image", "key", "word"))])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, numbers): the lines of run logs and all numbers in each."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return rows.withColumn("numbers", F.transform(F.regexp_extract_all("line", F.lit(r"(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0)), lambda x: x.cast("double")))


# ---- writers ----------------------------------------------------------------------------------


def _join(*cols) -> F:
    return F.concat_ws(" ", *[c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in cols])


def write_lines(df: DataFrame, path: str, *cols: str) -> None:
    """One line a row, columns by blanks; arrays are written out."""
    parts = [F.array_join(F.col(c).cast("array<string>"), " ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in cols]
    df.select(F.concat_ws(" ", *parts).alias("value")).write.text(path)


def write_shards(df: DataFrame, path: str, *cols: str) -> None:
    """write_lines into one folder a value of the column shard."""
    parts = [F.array_join(F.col(c).cast("array<string>"), " ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in cols]
    df.select("shard", F.concat_ws(" ", *parts).alias("value")).repartition("shard").write.partitionBy("shard").text(path)


def write_match_blocks(df: DataFrame, path: str) -> None:
    """Blocks of a pair, its count and its rows; a pair's block is one record."""
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ka", "kb"))), lambda m: F.concat_ws(" ", m["ka"].cast("string"), m["kb"].cast("string"))), "\n")
    block = F.concat_ws("\n", F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")), F.col("n").cast("string"), "rows")
    df.groupBy("a", "b").agg(F.count("*").alias("n"), rows.alias("rows")).select(block.alias("value")).write.text(path)


def write_tracks(df: DataFrame, path: str) -> None:
    """Lines: n (view key x y) x n [X Y Z]; NULL coordinates are not written as text but as 0."""
    one = lambda o: F.concat_ws(" ", o["view"].cast("string"), o["key"].cast("string"), o["x"].cast("string"), o["y"].cast("string"))
    cols = [F.size("obs").cast("string"), F.array_join(F.transform("obs", one), " ")]
    if "pos" in df.columns:
        cols.append(F.array_join(F.col("pos").cast("array<string>"), " "))
    df.select(F.concat_ws(" ", *cols).alias("value")).write.text(path)


def write_model(cameras: DataFrame, points: DataFrame, obs: DataFrame, path: str) -> None:
    """A model as sorted text records (header, cameras, points) in one ordered folder, which model() reads back as it
    is. Cameras that are not valid become five lines of zeros. Cameras and points are numbered by their order: ids with
    gaps come back without them (remap_ids)."""
    c = cameras.select(F.lit(1).alias("o"), F.col("view").alias("i"), F.when(F.col("valid"), F.concat_ws("\n", F.concat_ws(" ", F.col("f").cast("string"), F.col("k1").cast("string"), F.col("k2").cast("string")), *[F.array_join(F.slice("r", s, 3).cast("array<string>"), " ") for s in (1, 4, 7)], F.array_join(F.col("t").cast("array<string>"), " "))).otherwise("\n".join(["0 0 0"] * 5)).alias("value"))
    o = obs.groupBy("point").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "view", "key", "x", "y"))), lambda x: F.concat_ws(" ", x["view"].cast("string"), x["key"].cast("string"), x["x"].cast("string"), x["y"].cast("string"))), " ").alias("text"))
    p = points.join(o, "point", "left").select(F.lit(2).alias("o"), F.col("point").alias("i"), F.concat_ws("\n", F.array_join(F.col("pos").cast("array<string>"), " "), F.array_join(F.transform("rgb", lambda v: F.round(v * 255).cast("int").cast("string")), " "), F.concat_ws(" ", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("text", F.lit("")))).alias("value"))
    head = cameras.sparkSession.createDataFrame([(0, 0, f"# model\n{cameras.count()} {points.count()}")], "o int, i long, value string")
    head.union(c).union(p).repartitionByRange("o", "i").sortWithinPartitions("o", "i").select("value").write.text(path)


def write_cameras(cameras: DataFrame, path: str) -> None:
    """One camera a record of five lines, in a folder for each view (view=...)."""
    n = lambda c: F.format_string("%.8e", c)
    rows = [F.concat_ws(" ", n(F.col("f")), n(F.col("k1")), n(F.col("k2"))), *[F.concat_ws(" ", *[n(F.get("r", F.lit(s + i))) for i in range(3)]) for s in (0, 3, 6)], F.concat_ws(" ", *[n(F.get("t", F.lit(i))) for i in range(3)])]
    cameras.where("valid" if "valid" in cameras.columns else "true").select("view", F.concat_ws("\n", *rows).alias("value")).write.partitionBy("view").text(path)


def write_correspondences(rows: DataFrame, path: str) -> None:
    """Lines of point, view, key, x, y."""
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("point", "view", "key")], F.format_string("%f", F.col("x")), F.format_string("%f", F.col("y"))).alias("value")).write.text(path)


def write_point_matches(rows: DataFrame, path: str) -> None:
    """3D-2D correspondences of queries (query, key, point, x, y, px, py, pz): two lines each, key point x y
    and the coordinates of the point, in a folder for each query."""
    n = lambda *c: F.concat_ws(" ", *[F.format_string("%f", F.col(x)) for x in c])
    first = F.concat_ws(" ", F.col("key").cast("string"), F.col("point").cast("string"), n("x", "y"))
    rows.select("query", F.concat(first, F.lit("\n"), n("px", "py", "pz")).alias("value")).repartition("query").write.partitionBy("query").text(path)
