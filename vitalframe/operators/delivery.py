"""Messages delivered more than once: exact dictionary codes and sharded seen-bitmaps.

An arrival carries one or more identifiers. Every distinct identifier gets an exact dictionary code (shard, number within
the shard). Whether an identifier was seen is told by one bit per code, in bitmaps of 32,768 bits per (shard, bucket), and
by nothing else: the dictionary may hold identifiers that were encoded and not admitted yet. Of the arrivals with an unseen
bit the first is chosen, the others are surplus; then the new bits are united with the stored ones in one commit.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha1
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of a dictionary slot, about; a batch reads only the slots that its identifiers fall into.
SLOT_ROWS = 500_000
#: Distinct identifiers of a batch (some 40 bytes each) up to which they are broadcast to the dictionary, which then isn't shuffled.
BROADCAST_KEYS = 200_000
#: Dictionary segments above which the smaller ones are merged.
SEGMENTS = 12
ENTRY = "key binary, shard int, code long, copies long, slice int, slot int"
CODED = "origin string, no long, shard int, code long, slice int"
BITS = "shard int, bucket long, bitmap binary"
SURPLUS = "origin string, no long"


class Encoded(NamedTuple):
    """An encoded batch. coded: (origin, no, shard, code, slice) of the arrivals with an identifier that is repeated in the batch or
    was in the dictionary before; fresh: (shard, code, slice) of the other identifiers, which have one arrival and an unseen bit."""

    coded: DataFrame
    fresh: DataFrame


class StoreConflict(RuntimeError):
    """Another writer committed first; nothing of this batch is stored, it can be given again."""


def canonical_uuid(text):
    """The 32 lower-case hex digits of a UUID however written; null for null, empty, placeholder or malformed text.

    Accepted are upper and lower case, with or without hyphens, in braces, with the prefix urn:uuid: and with
    white space around. The nil UUID counts as a placeholder.
    """
    low = F.lower(F.trim(text))
    bare = F.replace(low, F.lit("-"), F.lit(""))
    # the regular expression only for the rarer spellings
    plain = F.when(F.length(bare) == 32, bare).otherwise(F.replace(F.regexp_replace(low, r"^urn:uuid:|[{}\s]", ""), F.lit("-"), F.lit("")))
    return F.when((F.length(plain) == 32) & F.unhex(plain).isNotNull() & (plain != "0" * 32), plain)


def hyphenated(hex32):
    """Lower-case hyphenated form of 32 hex digits; null stays null."""
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(hex32.isNotNull(), F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in cut]))


def content_key(tag: str, text):
    """An identifier as bytes, injective within its tag: `chN:` + 40 hex digits is packed into 21 bytes, other text kept.

    Null, empty and blank text identifies nothing and gives null.
    """
    packed = F.concat(F.lit(tag + "=").cast("binary"), F.substring(text, 3, 1).cast("binary"), F.unhex(F.substring(text, 5, 40)))
    plain = F.concat(F.lit(tag + ":").cast("binary"), text.cast("binary"))
    form = (F.octet_length(text) == 44) & text.startswith("ch") & F.substring(text, 3, 1).between("0", "9") & (F.substring(text, 4, 1) == ":")
    return F.when(form & (F.lower(text) == text) & F.unhex(F.substring(text, 5, 40)).isNotNull(), packed).when(F.trim(text) != "", plain)


def uuid_key(tag: str, text):
    return F.concat(F.lit(tag + "#").cast("binary"), F.unhex(canonical_uuid(text)))


class DeliveryStore:
    """Dictionary and seen-bitmaps under `path`; an absent path is an empty store.

    `<path>/log/<version>` are the commits. A commit is a small file that is written beside and renamed into place only if its
    name is free (atomic on HDFS and POSIX folders); commits are never replaced or deleted, so the version never goes back, a
    reader sees all of a batch or nothing of it, and of two writers one gets StoreConflict. Everything else lies in
    `<path>/data/<folder>`, one folder a writer; folders that no commit names are what a dead writer left.

    Dictionary: segments, one for each batch with new identifiers, in slots by hash. Shards belong to the writing tasks of a
    segment, so they are as large as a task's share and never grow: a small first batch makes one small shard, a large later one
    many. A batch is joined with the slots it falls into; up to BROADCAST_KEYS identifiers are broadcast, so the dictionary is
    scanned there and not shuffled. Segments are merged by halves (each identifier is rewritten about log n times).
    Bitmaps: what each commit adds, without trailing zero bytes and stored with zstd, united on reading.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file("").getFileSystem(self._conf)

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._file(name)):
            return None
        stream = self._fs.open(self._file(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """The file appears under its name whole; False where the name is taken."""
        spare = self._file(f"tmp/{uuid.uuid4().hex}")
        out = self._fs.create(spare, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._file(name).getParent())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(spare, self._file(name), options)
        except Exception as e:
            self._fs.delete(spare, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def version(self) -> int:
        """The number of the last commit, 0 for an empty store."""
        log = self._file("log")
        if not self._fs.exists(log):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        text = self._read(f"log/{version:012d}") if version else None
        return json.loads(text) if text else {"version": 0, "batch": None, "folder": None, "segments": [], "bits": [], "shards": 0}

    def _commit(self, state: dict, **changes) -> dict:
        new = state | {"batch": None, "folder": None} | changes | {"version": state["version"] + 1}
        if not self._create(f"log/{new['version']:012d}", json.dumps(new)):
            raise StoreConflict(f"version {new['version']} was committed by another writer")
        if new["batch"]:
            self._create(f"batches/{sha1(new['batch'].encode()).hexdigest()}", str(new["version"]))
        return new

    def _answered(self, batch: str, state: dict) -> int | None:
        """The version that took the batch; a marker is missing at most for the last commit, whose writer died before it."""
        if state["batch"] == batch:
            return state["version"]
        text = self._read(f"batches/{sha1(batch.encode()).hexdigest()}")
        return int(text) if text else None

    def _at(self, folder: str, name: str) -> str:
        return f"{self.path}/data/{folder}/{name}"

    def _save(self, df: DataFrame, folder: str, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self._at(folder, name))

    def _load(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(folder, name))

    def entries(self, state: dict | None = None) -> DataFrame:
        """The whole dictionary: key, shard, code, slot."""
        parts = [self._load(s["folder"], "entries", ENTRY) for s in (state or self.state())["segments"]]
        return self._union(parts, ENTRY)

    def bits(self, state: dict | None = None) -> DataFrame:
        """The seen-bitmaps: shard, bucket, bitmap."""
        parts = [self._load(f, "bits", BITS) for f in (state or self.state())["bits"]]
        return self._union(parts, BITS).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _slots(self, rows: int) -> int:
        """Slots for `rows` identifiers: a divisor of the shuffle partitions, so that each written partition holds whole slots."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return next(s for s in range(min(n, -(-rows // SLOT_ROWS) or 1), 0, -1) if n % s == 0)

    def _coded_entries(self, keys: DataFrame, base: int, slots: int) -> DataFrame:
        """Codes for new keys. Task and row number make a unique code; a task's rows are committed whole or not at all, and
        everything reads them back from there, so a task that runs again changes nothing."""
        out = keys.withColumns({"slot": F.pmod(F.hash("key"), F.lit(slots)), "_n": F.monotonically_increasing_id()})
        return out.select("key", (F.shiftright("_n", 33) + F.lit(base)).cast("int").alias("shard"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)).alias("code"), "copies", "slice", "slot")

    def _known(self, keys: DataFrame, n: int, state: dict) -> DataFrame:
        """(key, shard, code) of the keys that the dictionary has."""
        small, parts = n <= BROADCAST_KEYS, []
        for s in state["segments"]:
            part = self._load(s["folder"], "entries", ENTRY)
            if small and s["slots"] > 1:
                hit = [r[0] for r in keys.select(F.pmod(F.hash("key"), F.lit(s["slots"]))).distinct().collect()]  # at most the slots of a segment
                part = part.filter(F.col("slot").isin(hit))
            parts.append(part.select("key", "shard", "code"))
        return self._union(parts, "key binary, shard int, code long").join(F.broadcast(keys) if small else keys, "key")

    def encode(self, arrivals: DataFrame, no: str, keys: str, origin: str | None = None, slices: int = 1) -> Encoded:
        """Adds the identifiers of a batch to the dictionary, unseen, and gives its arrivals their codes.

        `no`: a unique number in arrival order (within `origin`); `keys`: an array of identifier bytes. Null and repeated
        identifiers of an array don't count. slice: 0 to slices - 1 by arrival number, equal spans of each origin.

        Scale: identifiers are reduced by partial aggregates (a hot one is a row per map task); the way back to the arrivals is
        an equi-join with the repeated and the known ones only, whose hot partitions adaptive execution splits.
        """
        state, folder = self.state(), uuid.uuid4().hex
        rows = arrivals.select((F.col(origin) if origin else F.lit("")).alias("origin"), F.col(no).cast("long").alias("no"), F.col(keys).alias("keys"))
        span = rows.groupBy("origin").agg(F.min("no").alias("a"), F.max("no").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # a row an origin
        part = F.lit(0)
        for r in span:
            if slices > 1 and r["b"] is not None:
                part = F.when(F.col("origin") == r["origin"], F.floor((F.col("no") - r["a"]) / F.lit((r["b"] - r["a"]) / slices + 1))).otherwise(part)
        flat = rows.select("origin", "no", part.cast("int").alias("slice"), F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        found, known = flat.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("slice").alias("slice")), None
        if state["segments"]:
            self._save(found, folder, "keys")
            found = self._load(folder, "keys", "key binary, copies long, slice int")
            n = found.count()
            self._save(self._known(found.select("key"), n, state), folder, "known")
            known = self._load(folder, "known", "key binary, shard int, code long")
            found = found.join(F.broadcast(known.select("key")) if n <= BROADCAST_KEYS else known.select("key"), "key", "left_anti")
        slots = self._slots(sum(r["n"] for r in span))
        self._save(self._coded_entries(found, state["shards"], slots), folder, "entries", "slot")
        new = self._load(folder, "entries", ENTRY)
        count, top = new.agg(F.count(F.lit(1)), F.max("shard")).first()
        again = new.filter("copies > 1").select("key", "shard", "code")
        again = again.unionByName(known) if known is not None else again
        self._save(flat.join(again, "key").select("origin", "no", "shard", "code", "slice"), folder, "coded")
        if count:
            state = self._commit(state, segments=[*state["segments"], {"folder": folder, "slots": slots, "rows": count}], shards=top + 1)
            if len(state["segments"]) > SEGMENTS:
                self._merge(state)
        return Encoded(self._load(folder, "coded", CODED), new.filter("copies = 1").select("shard", "code", "slice"))

    def admit_coded(self, encoded: Encoded, batch: str | None = None) -> DataFrame:
        """Takes encoded arrivals: (origin, no) of the surplus, that is of arrivals one of whose bits an earlier batch has set,
        or that another arrival with a smaller `no` was chosen for. Then the new bits are united with the stored ones.

        `batch` names the batch: one that was taken before, whenever, changes nothing and gets the stored answer.
        """
        state, folder = self.state(), uuid.uuid4().hex
        taken = self._answered(batch, state) if batch else None
        if taken:
            return self._load(self.state(taken)["folder"], "surplus", SURPLUS)
        place = {"bucket": F.expr("bitmap_bucket_number(code)"), "position": F.expr("bitmap_bit_position(code)")}
        firsts = encoded.coded.groupBy("shard", "code").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("copies")).withColumns(place)
        octet = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.expr("(shiftright(octet, cast(position % 8 as int)) & 1) = 1")
        # merged, not broadcast: bitmaps and codes compress so well that their files look small
        decided = firsts.join(self.bits(state).hint("merge"), ["shard", "bucket"], "left").withColumn("octet", octet).withColumn("seen", F.coalesce(bit, F.lit(False)))
        again = decided.filter("seen or copies > 1").select("shard", "code", "first_no", "seen").hint("merge")
        hit = encoded.coded.join(again, ["shard", "code"]).filter(F.col("seen") | (F.col("no") > F.col("first_no")))
        self._save(hit.select("origin", "no").distinct(), folder, "surplus")
        marks = encoded.coded.select("shard", "code").unionByName(encoded.fresh.select("shard", "code")).withColumns(place)
        new = marks.groupBy("shard", "bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bitmap"), F.max("position").alias("top"))
        self._save(new.select("shard", "bucket", F.expr("substring(bitmap, 1, cast(top div 8 as int) + 1)").alias("bitmap")), folder, "bits")
        self._commit(state, batch=batch, folder=folder, bits=[*state["bits"], folder])
        return self._load(folder, "surplus", SURPLUS)

    def admit(self, arrivals: DataFrame, no: str, keys: str, origin: str | None = None, batch: str | None = None, slices: int = 1) -> DataFrame:
        """Takes a batch, see encode and admit_coded; with `slices` in as many parts, one after the other.

        Arrivals without identifiers are never surplus. Identifiers of different origins must carry different tags. An arrival that
        is surplus by one identifier still makes its others seen.
        """
        names = [f"{batch}/{i}" if slices > 1 else batch for i in range(slices)] if batch else [None] * slices
        encoded, out = None, []
        for i, name in enumerate(names):
            if encoded is None and not (name and self._answered(name, self.state())):
                encoded = self.encode(arrivals, no, keys, origin, slices)
            out.append(self.admit_coded(Encoded(*[x.filter(F.col("slice") == i) for x in encoded]) if encoded else None, name))
        return self._union(out, SURPLUS)

    def _merge(self, state: dict) -> None:
        """Merges the last segments, those before which one more than twice as large lies, and all bitmaps. Codes stay as they are."""
        segments, at = state["segments"], len(state["segments"]) - 1
        while at and segments[at - 1]["rows"] <= 2 * sum(s["rows"] for s in segments[at:]):
            at -= 1
        tail, folder = segments[at:], uuid.uuid4().hex
        rows = sum(s["rows"] for s in tail)
        slots = self._slots(rows)
        one = self.entries({"segments": tail}).withColumn("slot", F.pmod(F.hash("key"), F.lit(slots)))
        self._save(one.repartition("key"), folder, "entries", "slot")
        self._save(self.bits(state), folder, "bits")
        self._commit(state, segments=[*segments[:at], {"folder": folder, "slots": slots, "rows": rows}], bits=[folder])


def first_arrivals(arrivals: DataFrame, no: str, keys: str) -> DataFrame:
    """The `no` of the surplus of a whole log at once, without a store: arrivals that share an identifier with one of a smaller `no`.

    Identifiers are reduced by partial aggregates; only the repeated ones are joined back, by adaptive, skew-splitting joins.
    """
    flat = arrivals.select(F.col(no).cast("long").alias("no"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    again = flat.groupBy("key").agg(F.min("no").alias("first_no"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key", "first_no")
    return flat.join(again, "key").filter("no > first_no").select("no").distinct()


def sample_keys(samples: DataFrame) -> DataFrame:
    """Arrivals of a samples log: the content id and the UUID identify a message."""
    return samples.select(F.lit("samples").alias("origin"), F.col("row_id").alias("no"), F.array(content_key("s", F.col("sample_id")), uuid_key("u", F.col("hk_uuid"))).alias("keys"))


def batch_keys(batches: DataFrame) -> DataFrame:
    """Arrivals of a batch feed: the batch id identifies a delivery."""
    return batches.select(F.lit("batches").alias("origin"), F.col("delivery_no").alias("no"), F.array(content_key("b", F.col("batch_id"))).alias("keys"))
