"""Incremental loading of new start dates into a cube store.

``update`` is one idempotent run: list and parse the file set, find starts
not stored yet, decode their files, check them against the store's axes,
apply the tolerated-error gate and append. ``ingest_stream`` does the same
continuously with Structured Streaming: the file source's checkpoint records
which files were seen, and each micro-batch is appended by ``foreachBatch``
after dropping starts that are already stored (a replayed batch writes
nothing twice).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridcube.model import Axes, GridCube
from gridcube.operators.align import check_region, densify, new_times, raise_on_region_errors
from gridcube.operators.quality import error_rate_gate
from gridcube.sources import listing as LS
from gridcube.sources.decode import file_errors
from gridcube.sources.ingest import FILE_DIM_NAMES, IngestError, assign_file_dims, promote_time_dim
from gridcube.plans.strategy import join_small, keep_small, localize, mark_small, settled
from gridcube.sources.store import read_cells, read_meta, remove_path, store_exists, stored_times, write_cube
from gridcube.streaming.ledger import failed_files, read_ledger, record, superseded

TIME = Axes.INGEST_TIME

# decode(files) -> cells of those files with ``path``, in-file dims, data
# variables and an ``error`` column (NULL when the file decoded fine).
Decode = Callable[[DataFrame], DataFrame]


class LateStartError(IngestError):
    pass


def _file_axes(axes: LS.DatasetCoords) -> dict[str, DataFrame]:
    out = {}
    for c, ax in (("m", axes.M), ("p", axes.P), ("l", axes.L)):
        if ax is not None:
            name = FILE_DIM_NAMES[c]
            out[name] = ax.withColumnRenamed(ax.columns[0], name)
    return out


def update(spark: SparkSession, descriptor: LS.FileSetDescriptor, store: str, listing: DataFrame,
           decode: Decode, data_vars: Iterable[str] | None, grid_dims: Iterable[str],
           limit: int | None = None, first=None, attrs: Mapping | None = None,
           ds_attrs: Mapping | None = None, narrow: bool = True, refill: bool = False,
           eager_gate: bool = False, grid: Mapping[str, Iterable] | None = None) -> bool:
    """Bring the store up to date; returns whether it changed.

    The descriptor's options shape each decoded file as the reference's file
    opener does: ``data_vars`` keeps only those variables, ``drop_coords``
    must name existing columns and drops them, ``original_time_dim`` is a
    file-internal start promoted to the time dimension, and float64 data
    variables are stored as float32 (``narrow``).

    A start that is already stored is not revisited, even when some of its
    files failed to load. ``refill=True`` reloads every stored start that
    lacks data from one of its listed files (the whole start is rewritten,
    replacing its partition). ``eager_gate`` checks the failure rate after
    every load in submission order (start, member, level, lead) instead of
    once for the batch.

    The grid of the store is ``grid`` (labels per dimension in stored order),
    or for dimensions that it does not name the labels of the first slice.
    A slice with another label is an error, and nothing of it is written.
    What became of every file is kept in the store's ledger
    (``streaming.ledger``), error texts included."""
    # one row per file coordinate; every later decision (axes, starts, the
    # files to load) derives from this table, so the listing is parsed once
    # (and held driver-local when it is coordinate-sized)
    listed = f"{store.rstrip('/')}_staging/listing-{uuid.uuid4().hex}"
    try:
        versions = settled(LS.newest_files(LS.parse_paths(listing, descriptor)), listed)
        return _update(spark, descriptor, store, versions, decode, data_vars, grid_dims, limit, first, attrs,
                       ds_attrs, narrow, refill, eager_gate, grid)
    finally:
        remove_path(spark, listed)


def _update(spark, descriptor, store, versions, decode, data_vars, grid_dims, limit, first, attrs, ds_attrs,
            narrow, refill, eager_gate, grid) -> bool:
    """:func:`update` from the newest file of every coordinate."""
    files = keep_small(versions, versions.drop("version"))
    axes = LS.coord_index(files)
    file_axes = _file_axes(axes)
    dims = (TIME, *file_axes, *grid_dims)
    if data_vars is None:
        data_vars = descriptor.data_vars
    if data_vars is None:
        raise IngestError("name the data variables (descriptor.data_vars or data_vars=)")
    data_vars = tuple(data_vars)
    initialized = False
    stagings: list[str] = []  # removed once their cells are published
    runs: list[tuple] = []  # what the ledger says of them then
    # coordinates that vary per start are kept with the cells as <c>_expanded;
    # aux coordinates do not vary with the start and are stored once
    expanded = {c: f"{c}_expanded" for c in descriptor.expand_coords}
    aux = list(descriptor.aux_coords)
    extra_meta = {"cell_coords": {n: [TIME, *grid_dims] for n in expanded.values()},
                  "table_coords": {c: list(grid_dims) for c in aux}}

    def load(files_now: DataFrame) -> DataFrame:
        # decode once into a staging table on the shared file system: the gate
        # and the append both read it, and a lost executor does not re-decode
        staging = f"{store.rstrip('/')}_staging/{uuid.uuid4().hex}"
        decode(files_now).write.parquet(staging)
        stagings.append(staging)
        decoded = spark.read.parquet(staging)
        outcomes = file_errors(decoded)
        known = join_small(versions, files_now.select("path"), "path", "left_semi").join(outcomes, "path", "left")
        status = F.when(F.col("error").isNull(), "loaded").otherwise("failed")
        runs.append((f"update-{uuid.uuid4().hex}", known, status))
        record(store, runs[-1][0], known.where("error IS NOT NULL"), F.lit("failed"), F.col("error"))
        if eager_gate:
            outcomes = outcomes.join(files_now.select("path", "t", "m", "p", "l"), "path")
            good = error_rate_gate(outcomes, order=["t", "m", "p", "l"])
        else:
            good = error_rate_gate(outcomes)  # raises above the tolerated rate
        ok = decoded.join(good.select("path"), "path", "left_semi").drop("error")
        missing = [c for c in descriptor.drop_coords if c not in ok.columns]
        if missing:
            raise IngestError(f"cannot drop {missing}: not in the decoded files")
        ok = ok.drop(*descriptor.drop_coords)
        absent = [c for c in [*expanded, *aux] if c not in ok.columns]
        if absent:
            raise IngestError(f"coordinates {absent} are not in the decoded files")
        file_coords = [c for c in ("m", "p", "l") if FILE_DIM_NAMES[c] in file_axes]
        if descriptor.original_time_dim:
            cells = promote_time_dim(ok, files_now, descriptor.original_time_dim, key="path",
                                     coords=file_coords)
        else:
            cells = assign_file_dims(ok, files_now, key="path", coords=file_coords)
        cells = cells.select(*dims, *data_vars, *[F.col(c).alias(n) for c, n in expanded.items()], *aux)
        if narrow:
            types = dict(cells.dtypes)
            cells = cells.withColumns({v: F.col(v).cast("float") for v in data_vars if types[v] == "double"})
        return cells

    if not store_exists(spark, store):
        t_first = LS.list_times(files, first).agg(F.min("t")).first()[0]
        if t_first is None:
            if first is not None and files.limit(1).count() > 0:
                raise IngestError(f"no start at or after {first} under {descriptor.dir}")
            raise IngestError(f"no files match {descriptor.pattern!r} under {descriptor.dir}")
        cells = load(files.filter(F.col("t") == F.lit(t_first)))
        for c in aux:  # from the first start, like the reference's first slice
            (cells.select(*grid_dims, c).dropDuplicates(list(grid_dims))
                  .write.mode("overwrite").parquet(f"{store}/coords/{c}"))
        cells = cells.drop(*aux)
        # missing files of the first start become all-missing slices
        template = cells.select(TIME, *grid_dims).distinct()
        cube = GridCube(cells=cells, dims=dims, data_vars=data_vars, attrs=dict(attrs or {}),
                        ds_attrs=dict(ds_attrs or {}),
                        encodings={TIME: {"units": f"{descriptor.time_res} since 1960-01-01",
                                          "dtype": "int32"}},
                        descending=frozenset(n for n in file_axes if n == "P"))
        cube = densify(cube, template, file_axes)
        fixed = {d: [r[0] for r in ax.orderBy("pos").collect()] for d, ax in file_axes.items()}
        declared = {d: labels for d, labels in (grid or {}).items() if d in grid_dims}
        write_cube(cube.with_index(**declared), store, mode="overwrite", fixed_axes=fixed, extra_meta=extra_meta,
                   conform=tuple(declared))
        _publish(spark, store, stagings, runs)
        initialized = True
        if limit is not None:
            limit -= 1
    stored = localize(stored_times(spark, store))  # one row per stored start
    todo = localize(new_times(files, stored.select(F.col(TIME).alias("t")), first=first,
                              limit=limit if limit is None else max(limit, 0)))
    if refill:
        refilled = _refill(spark, store, files, file_axes, data_vars, load)
        initialized = initialized or refilled
    bounds = todo.agg(F.min("t").alias("lo")).first()
    if bounds["lo"] is None:
        _publish(spark, store, stagings, runs)
        return initialized
    last_old = stored.agg(F.max(TIME)).first()[0]
    if last_old is not None and bounds["lo"] < last_old:
        raise LateStartError("a start prior to the newest stored one cannot be added")
    chosen = LS.path_lookup(files, todo)
    # every file's M/P/L label must already be on the store's axes
    labels = chosen.select("path", *[F.col(c).alias(FILE_DIM_NAMES[c]) for c in ("m", "p", "l")
                                     if FILE_DIM_NAMES[c] in file_axes])
    if file_axes:
        fixed = read_meta(spark, store).get("fixed_axes", {})
        types = dict(labels.dtypes)
        store_axes = {d: mark_small(spark.createDataFrame([(v, i) for i, v in enumerate(fixed.get(d, []))],
                                                          f"{d} {types[d]}, pos int"))
                      for d in file_axes}
        raise_on_region_errors(check_region(labels, store_axes))
    cells = load(chosen).drop(*aux)
    write_cube(GridCube(cells=cells, dims=dims, data_vars=data_vars), store, mode="append", conform=tuple(grid_dims))
    _publish(spark, store, stagings, runs)
    return True


def _publish(spark: SparkSession, store: str, stagings: list[str], runs: list[tuple]) -> None:
    """Once cells are in the store, the ledger says so and their staging
    tables are scratch; a failed run leaves its staging table for inspection."""
    while runs:
        batch, known, status = runs.pop()
        record(store, batch, known, status, F.col("error"))
    while stagings:
        remove_path(spark, stagings.pop())


def _refill(spark: SparkSession, store: str, files: DataFrame, file_axes, data_vars, load) -> bool:
    """Reload stored starts where a listed file left no data."""
    from gridcube.sources.store import read_cube
    fdims = list(file_axes)
    names = {FILE_DIM_NAMES[c]: c for c in ("m", "p", "l")}
    cells = read_cube(spark, store).cells
    has_data = None
    for v in data_vars:
        e = F.col(v).isNotNull()
        has_data = e if has_data is None else has_data | e
    present = (cells.filter(has_data).select(F.col(TIME).alias("t"),
                                             *[F.col(d).alias(names[d]) for d in fdims]).distinct())
    stored_t = localize(stored_times(spark, store)).withColumnRenamed(TIME, "t")
    listed = join_small(files, stored_t, "t", "left_semi")
    gaps = listed.join(present, ["t", *[names[d] for d in fdims]], "left_anti").select("t").distinct()
    gaps = localize(gaps)
    if gaps.limit(1).count() == 0:
        return False
    chosen = LS.path_lookup(files, gaps)
    write_cube(GridCube(cells=load(chosen), dims=(TIME, *fdims, *[c for c in cells.columns
                                                                  if c not in (TIME, *fdims, *data_vars)]),
                        data_vars=tuple(data_vars)), store, mode="append")
    return True


def run_summary(spark: SparkSession, runs: Mapping[str, Callable[[], bool]]) -> DataFrame:
    """Run each variable's update; one failure does not stop the others.
    Returns ``(var, status, message)``."""
    rows = []
    for var, fn in runs.items():
        try:
            modified = fn()
            rows.append((var, "modified" if modified else "unchanged", None))
        except Exception as e:  # noqa: BLE001 - reported per variable
            rows.append((var, "error", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "var string, status string, message string")


# ------------------------------------------------------------------ streaming
def _split_known(batch: DataFrame, stored: DataFrame, time_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of starts that the store has, and of starts that it has not."""
    return join_small(batch, stored, time_col, "left_semi"), join_small(batch, stored, time_col, "left_anti")


def _merge_into(spark: SparkSession, store: str, cells: DataFrame, dims: tuple, data_vars: tuple,
                time_col: str, staging: str, attrs: Mapping | None = None, replaced: tuple | None = None,
                grid: Mapping[str, Iterable] | None = None, fixed: tuple = ()) -> None:
    """Append ``cells``, one row per dims; where the store has a start already,
    its other cells stay. What is new replaces the stored cells with the same
    ``replaced`` dims (all dims by default; those of a file, where a whole file
    is replaced), so replaying a batch changes nothing and members that come
    in later batches are added. Starts that are new are not merged at all."""
    cells.write.mode("overwrite").parquet(staging)
    new = spark.read.schema(cells.schema).parquet(staging)
    merged = f"{staging}-merged"
    cube = GridCube(cells=new, dims=dims, data_vars=data_vars, attrs=dict(attrs or {}))
    declared = {d: labels for d, labels in (grid or {}).items() if d in dims}
    if store_exists(spark, store):
        keys = list(replaced or dims)
        starts = join_small(localize(stored_times(spark, store)), localize(new.select(time_col).distinct()), time_col, "left_semi")
        starts = localize(starts)
        if starts.limit(1).count():
            old = join_small(read_cells(spark, store).select(*dims, *data_vars), starts, time_col, "left_semi")
            stay = old.join(new.select(*keys).distinct(), keys, "left_anti")
            new.unionByName(stay).write.mode("overwrite").parquet(merged)
            cube = cube.replace(cells=spark.read.schema(cells.schema).parquet(merged))
        write_cube(cube, store, mode="append", conform=fixed)
    else:
        write_cube(cube.with_index(**declared), store, mode="append", conform=tuple(declared))
    remove_path(spark, merged)
    remove_path(spark, staging)


def late_start_guard(incoming: DataFrame, stored_max, time_col: str = TIME) -> DataFrame:
    """Label each incoming start ``late`` (earlier than the newest stored
    start) or ``accepted``."""
    late = F.lit(stored_max).cast("timestamp_ntz") if stored_max is not None else None
    status = F.lit("accepted") if late is None else \
        F.when(F.col(time_col) < late, F.lit("late")).otherwise(F.lit("accepted"))
    return incoming.withColumn("status", status)


def ingest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, store: str,
                  checkpoint: str, dims: Iterable[str], data_vars: Iterable[str],
                  time_col: str = TIME, on_late: str = "raise", late_dir: str | None = None,
                  attrs: Mapping | None = None, max_files_per_trigger: int | None = None,
                  available_now: bool = True, grid_dims: Iterable[str] | None = None,
                  grid: Mapping[str, Iterable] | None = None) -> StreamingQuery:
    """Stream Parquet slices from ``source_dir`` into the store at ``store``.

    ``on_late``: ``raise`` fails the batch on a start earlier than the newest
    stored one; ``divert`` writes such rows to ``late_dir`` instead, each batch
    to a folder of its own, so a replay writes them once. Of cells with the
    same dims in one batch, the one of the newest file stays (then of the one
    with the greatest path). A label that the grid of the store lacks fails
    the batch; the grid is that of ``grid_dims`` (Y and X by default), with the
    labels of ``grid`` or else of the first batch.
    """
    dims, data_vars = tuple(dims), tuple(data_vars)
    fixed = tuple(d for d in dims if d in ((Axes.Y, Axes.X) if grid_dims is None else tuple(grid_dims)))
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir).select(*dims, *data_vars, F.struct(
        "_metadata.file_modification_time", "_metadata.file_path").alias("_version"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        best = F.max(F.struct("_version", *data_vars)).alias("_best")
        batch = batch.groupBy(*dims).agg(best).select(*dims, *[f"_best.{v}" for v in data_vars])
        if store_exists(spark, store):
            stored = localize(stored_times(spark, store))
            stored_max = stored.agg(F.max(time_col)).first()[0]
            known, batch = _split_known(batch, stored, time_col)
        else:
            stored_max, known = None, None
        labelled = late_start_guard(batch, stored_max, time_col)
        late = labelled.filter(F.col("status") == "late")
        if stored_max is not None and late.limit(1).count() > 0:
            if on_late == "raise":
                raise LateStartError("a start prior to the newest stored one cannot be added")
            late.drop("status").write.mode("overwrite").parquet(f"{late_dir or f'{store}_late'}/batch={batch_id}")
        ok = labelled.filter(F.col("status") == "accepted").drop("status")
        _merge_into(spark, store, ok if known is None else ok.unionByName(known), dims, data_vars, time_col,
                    f"{store.rstrip('/')}_staging/batch-{batch_id}", attrs, grid=grid, fixed=fixed)

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

# Files of one retry that are read at once (their paths go into one plan).
RETRY_FILES = 10_000


class FileLoader:
    """Loads batches of raw files ``(path, modificationTime, content)`` into a
    store: parse, pick the newest per coordinate, leave out what the ledger
    supersedes, decode, gate, check, replace file by file, and record."""

    def __init__(self, descriptor: LS.FileSetDescriptor, decoder, schema: T.StructType, store: str,
                 grid_dims: Iterable[str], data_vars: Iterable[str], file_dims: Iterable[str] = ("m",),
                 on_late: str = "raise", narrow: bool = True, grid: Mapping[str, Iterable] | None = None,
                 late_dir: str | None = None):
        self.late_dir = late_dir or f"{store.rstrip('/')}_late"
        self.descriptor, self.decoder, self.schema, self.store = descriptor, decoder, schema, store
        self.grid_dims, self.data_vars, self.file_dims = tuple(grid_dims), tuple(data_vars), tuple(file_dims)
        self.on_late, self.narrow, self.grid = on_late, narrow, grid
        self.keys = (TIME, *(FILE_DIM_NAMES[c] for c in self.file_dims))

    def __call__(self, raw: DataFrame, batch: str, gated: bool = True) -> None:
        try:
            self._load(raw, batch, gated)
        finally:  # tables of files; decoded cells stay for inspection where a load failed
            for part in ("files", "status", "judged"):
                remove_path(raw.sparkSession, f"{self.store.rstrip('/')}_staging/batch-{batch}-{part}")

    def _load(self, raw: DataFrame, batch: str, gated: bool) -> None:
        from gridcube.sources.decode import decode_content
        spark, store = raw.sparkSession, self.store
        staging = f"{store.rstrip('/')}_staging/batch-{batch}"
        parsed = LS.parse_paths(raw.select("path", "modificationTime", "content"), self.descriptor)
        # the tables of files are computed once, so that contents are read for decoding only
        files = settled(LS.newest_files(parsed.drop("content")), f"{staging}-files")
        ledger = read_ledger(spark, store).where(F.col("batch") != batch)
        old = localize(superseded(files, ledger).select("path")).withColumn("status", F.lit("superseded"))
        status = join_small(files, old, "path", "left")
        if store_exists(spark, store):
            stored = localize(stored_times(spark, store)).withColumnRenamed(TIME, "t")
            newest = stored.agg(F.max("t")).first()[0]
            there = F.broadcast(stored.withColumn("_there", F.lit(True)))
            late = F.col("_there").isNull() & (F.col("t") < F.lit(newest).cast("timestamp_ntz")) & F.col("status").isNull()
            status = status.join(there, "t", "left").withColumn("status", F.when(late, "late").otherwise(F.col("status"))).drop("_there")
        status = settled(status.select(*files.columns, "status"), f"{staging}-status")
        late = keep_small(status, status.where("status = 'late'").drop("status"))
        if late.limit(1).count():
            if self.on_late == "raise":
                raise LateStartError("a start prior to the newest stored one cannot be added")
            late.withColumnRenamed("t", TIME).write.mode("overwrite").parquet(f"{self.late_dir}/batch={batch}")
        chosen = keep_small(status, status.where("status IS NULL").drop("status"))
        if not chosen.limit(1).count():
            record(store, batch, status, F.col("status"))
            return
        decode_content(join_small(parsed, chosen.select("path"), "path", "left_semi"), self.decoder, self.schema) \
            .write.mode("overwrite").parquet(staging)
        decoded = spark.read.parquet(staging)
        outcomes = file_errors(decoded)
        judged = settled(status.join(outcomes, "path", "left"), f"{staging}-judged")
        said = F.coalesce("status", F.when(F.col("error").isNotNull(), "failed").otherwise("loaded"))
        record(store, batch, judged.where("error IS NOT NULL OR status IS NOT NULL"), said, F.col("error"))
        good = error_rate_gate(outcomes) if gated else outcomes.where("error IS NULL")
        if not gated and not good.limit(1).count():
            remove_path(spark, staging)
            return
        cells = assign_file_dims(decoded.join(good.select("path"), "path", "left_semi").drop("error"),
                                 chosen.drop("version"), key="path", coords=list(self.file_dims))
        dims = (*self.keys, *self.grid_dims)
        cells = cells.select(*dims, *self.data_vars)
        if self.narrow:
            types = dict(cells.dtypes)
            cells = cells.withColumns({v: F.col(v).cast("float") for v in self.data_vars if types[v] == "double"})
        _merge_into(spark, store, cells, dims, self.data_vars, TIME, f"{staging}-cells", replaced=self.keys,
                    grid=self.grid, fixed=self.grid_dims)
        record(store, batch, judged, said, F.col("error"))
        remove_path(spark, staging)

    def retry_failed(self, spark: SparkSession) -> int:
        """Load the files again that the ledger lists as failed, however many
        fail again; returns how many there were. A file that is gone by now stays listed."""
        paths = [r["path"] for r in failed_files(spark, self.store).select("path").toLocalIterator()]
        run = uuid.uuid4().hex
        for k in range(0, len(paths), RETRY_FILES):
            raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths[k:k + RETRY_FILES])
            self(raw, f"retry-{run}-{k // RETRY_FILES}", gated=False)
        return len(paths)


def ingest_file_stream(spark: SparkSession, descriptor: LS.FileSetDescriptor, decoder,
                       schema: T.StructType, store: str, checkpoint: str, grid_dims: Iterable[str],
                       data_vars: Iterable[str], file_dims: Iterable[str] = ("m",),
                       on_late: str = "raise", late_dir: str | None = None, narrow: bool = True,
                       max_files_per_trigger: int | None = None, available_now: bool = True,
                       grid: Mapping[str, Iterable] | None = None, delivery: str = "") -> StreamingQuery:
    """Stream raw files of a file set straight into a store.

    Each micro-batch of new files (binaryFile source; its checkpoint records
    the files already seen) goes through a :class:`FileLoader`. Of the files of
    one coordinate the newest wins, in whatever batch it comes: it replaces the
    whole slice of an older one, and an older one that comes later is left
    out. Files that cannot be read are kept in the ledger with their error
    (``FileLoader.retry_failed`` loads them again); beyond the tolerated rate
    they fail the batch. Starts before the newest stored one fail the batch, or
    with ``on_late="divert"`` are listed as late, in the ledger and in
    ``late_dir`` (a folder for each batch). A label that the grid of the
    store lacks fails the batch. A replayed batch leaves the store as it is.
    ``file_dims`` names the file coordinates that are axes.

    Spark's source keeps every file of its folder on the driver, some kilobytes
    each. A backlog of very many files is loaded folder by folder, in the order
    of starts: a stream for each, with a checkpoint of its own and its own
    ``delivery``, which begins the names of its batches in the ledger.
    """
    load = FileLoader(descriptor, decoder, schema, store, grid_dims, data_vars, file_dims, on_late, narrow, grid, late_dir)
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    few_listing_tasks(spark)
    stream = reader.load(descriptor.dir)
    w = stream.writeStream.foreachBatch(lambda batch, batch_id: load(batch, f"{delivery}{batch_id}")) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def few_listing_tasks(spark: SparkSession) -> None:
    """Spark lists folders and files in a task for each, up to 10,000 tasks; a
    few a core take a fraction of the time. A stream lists in each batch, so
    the setting stays; one that somebody made stays as it is."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
