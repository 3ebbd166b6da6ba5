"""Bars from a vendor's pages as a Spark data source: pages newest first, tries with growing waits, a limit of requests.

    write_pages(bars, path)
    spark.dataSource.register(VendorBars)
    spark.read.format("vendor_bars").option("path", path).option("since", "2024-01-01").load()

Pages lie in Parquet: bucket=<k>/ with code, page (0 the newest) and body, lines of date,open,high,low,close,volume from the
newest to the oldest, as the vendor answers a request. Another vendor is another `get`."""

from __future__ import annotations

import datetime
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The vendor takes 60 requests in 15 seconds; a request is tried 4 times, 1.5 s, 3 s and 4.5 s apart.
REQUESTS, SECONDS, TRIES, PAUSE = 60, 15.0, 4, 1.5
ROW_GROUP = 16 << 20  # bytes of pages that a reader holds at a time, about
SCHEMA = "code string, d date, o double, h double, l double, c double, v double"


class Limiter:
    """Lets at most n requests through in any `seconds`; n 0 lets all through."""

    def __init__(self, n: int, seconds: float, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.n, self.seconds, self.clock, self.sleep = n, seconds, clock, sleep
        self.times: deque[float] = deque(maxlen=max(1, n))

    def wait(self) -> None:
        if not self.n:
            return
        if len(self.times) == self.n:
            left = self.times[0] + self.seconds - self.clock()
            if left > 0:
                self.sleep(left)
        self.times.append(self.clock())


def fetched(get: Callable[[str, int], str | None], code: str, page: int, limiter: Limiter, tries: int = TRIES, pause: float = PAUSE) -> str | None:
    """A page's body, None past the last one. What fails is tried again after pause, twice and three times that; each try is
    a request. The last failure is raised."""
    for k in range(tries):
        limiter.wait()
        try:
            return get(code, page)
        except Exception:
            if k == tries - 1:
                raise
            limiter.sleep(pause * (k + 1))
    return None


def rows_of(body: str) -> list[tuple]:
    out = []
    for line in body.splitlines():
        day, *numbers = line.split(",")
        out.append((datetime.date(int(day[:4]), int(day[4:6]), int(day[6:8])), *map(float, numbers)))
    return out


def bars_of(get: Callable[[str, int], str | None], code: str, limiter: Limiter, since: datetime.date | None = None, until: datetime.date | None = None, most: int = 0, **more) -> list[tuple]:
    """A code's bars, oldest first: page after page back in time, no further than `since`, or than the newest `most`."""
    out: list[tuple] = []
    page = 0
    while (body := fetched(get, code, page, limiter, **more)) is not None:
        rows = rows_of(body)
        out += [r for r in rows if (since is None or r[0] >= since) and (until is None or r[0] <= until)]
        if not rows or (most and len(out) >= most) or (since is not None and rows[-1][0] < since):
            break
        page += 1
    return sorted(out[:most] if most else out)


class PageStore:
    """The pages of one bucket. Where each page lies is read once; bodies are read a row group at a time, and those of the
    last one stay, so that codes asked for in the order of the files cost one pass over them."""

    def __init__(self, path: str, bucket: int):
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        found = files.get_file_info(fs.FileSelector(f"{root}/bucket={bucket}", allow_not_found=True))
        self.groups: list[tuple] = []  # a file and the number of its row group
        self.at: dict[str, dict[int, tuple[int, int]]] = {}  # of a code's page: the row group and the row in it
        self.last, self.bodies = -1, None
        for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
            file = pq.ParquetFile(name, filesystem=files)
            for k in range(file.num_row_groups):
                keys = file.read_row_group(k, columns=["code", "page"])
                for i, (code, page) in enumerate(zip(keys["code"].to_pylist(), keys["page"].to_pylist(), strict=True)):
                    self.at.setdefault(code, {}).setdefault(page, (len(self.groups), i))
                self.groups.append((file, k))

    def codes(self) -> list[str]:
        return list(self.at)

    def get(self, code: str, page: int) -> str | None:
        group, i = self.at.get(code, {}).get(page, (None, 0))
        if group is None:
            return None
        if group != self.last:
            file, k = self.groups[group]
            self.last, self.bodies = group, file.read_row_group(k, columns=["body"])["body"]
        return self.bodies[i].as_py()


class Bucket(InputPartition):
    def __init__(self, k: int):
        super().__init__(k)
        self.k = k


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.buckets = int(options.get("buckets", 4))
        self.codes = set(options["codes"].split(",")) if options.get("codes") else None
        day = lambda k: datetime.date.fromisoformat(options[k]) if options.get(k) else None
        self.since, self.until = day("since"), day("until")
        self.least, self.most = int(options.get("least", 130)), int(options.get("most", 0))
        self.requests, self.seconds = int(options.get("requests", REQUESTS)), float(options.get("seconds", SECONDS))
        self.tries, self.pause = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))

    def partitions(self) -> list[Bucket]:
        return [Bucket(k) for k in range(self.buckets)]

    def share(self) -> int:
        """A reader's part of the limit: all may run at once, and know nothing of each other."""
        if 0 < self.requests < self.buckets:
            raise ValueError("more readers than requests: each needs one at least")
        return self.requests // self.buckets

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        import time

        store = PageStore(self.path, partition.k)
        limiter = Limiter(self.share(), self.seconds, time.monotonic, time.sleep)
        for code in store.codes():
            if self.codes is not None and code not in self.codes:
                continue
            try:
                rows = bars_of(store.get, code, limiter, self.since, self.until, self.most, tries=self.tries, pause=self.pause)
            except Exception:  # a code that can't be had is left out, as are short ones
                continue
            if len(rows) >= max(1, self.least):
                d, *numbers = zip(*rows, strict=True)
                cols = [pa.array([code] * len(rows)), pa.array(d, pa.date32()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.record_batch(cols, ["code", "d", "o", "h", "l", "c", "v"])


class VendorBars(DataSource):
    """Daily bars by code, each code's oldest first: code, d, o, h, l, c, v.

    Options: path; codes, separated by commas (all if not given); since and until, days; most, the newest so many bars of
    a code; least (130): codes with fewer bars in that span are left out, as are those of which a page fails `tries` (4)
    times, `pause` (1.5) s and its multiples apart; requests (60, 0 for no limit) in `seconds` (15), shared out evenly
    among the `buckets` (4) readers, of which each holds one code's bars at a time."""

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options)


def bucket_of(code: str, buckets: int) -> int:
    return zlib.crc32(code.encode()) % buckets


def write_pages(bars: DataFrame, path: str, page: int = 200, buckets: int = 4) -> None:
    """Stores bars as a vendor's pages of so many bars, in as many buckets by crc32 of the code."""
    code = F.col("code").cast("string")
    back = F.row_number().over(W.partitionBy("code").orderBy(F.desc("d"))) - 1
    line = F.concat_ws(",", F.date_format("d", "yyyyMMdd"), *[F.col(x).cast("double").cast("string") for x in "ohlcv"])
    lines = bars.select(code.alias("code"), "d", line.alias("line"), F.floor(back / page).cast("int").alias("page"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "line")), asc=False), lambda r: r["line"]), "\n")
    pages = lines.groupBy("code", "page").agg(body.alias("body"))  # a page's bars
    pages = pages.withColumn("bucket", (F.crc32(F.col("code").cast("binary")) % buckets).cast("int"))
    pages.repartition(buckets, "bucket").sortWithinPartitions("bucket", "code", "page").write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(path)
