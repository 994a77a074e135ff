"""Sites as adapters: pages in a folder become listings, as a batch or stream source, or page by page in SQL.

An adapter says by which marker a site's list pages are known and which objects of their structured data are listings.
`spark.read.format("listing_pages").load(folder)` reads the JSON lines (url, html) of `folder/source=<adapter>/`, a
partition a file, plain or compressed as its name's ending says; the same format streams, with the files read so far as its offset. `page_listings(source, html)` is
the same as a table function, for lateral joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.functions import udtf

from ..functions.pages import LD_JSON, STATE, trees, walk

LISTING = (
    "source_url string, source_id string, deal_type string, condo_name string, price double, area_sqm double,"
    " bedrooms int, bathrooms int, district string, lat double, lng double"
)
FIELDS = [x.split()[0] for x in LISTING.split(", ")]
PAGE = f"source string, page_url string, {LISTING}"
PROBE = "source string, ok boolean, reason string"


def blocks(pattern: str, html: str) -> list[str]:
    return [m.strip() for m in re.findall(pattern, html)]


def number(x, kind: Callable = float):
    """A number out of a number or a text that is one; null for anything else."""
    try:
        return None if isinstance(x, bool) or x is None else kind(x)
    except (TypeError, ValueError, OverflowError):
        return None


def digits(pattern: str, text: str | None, kind: Callable = int):
    found = re.search(pattern, text or "", re.I)
    return number(found[1].replace(",", ""), kind) if found else None


def ending(pattern: str, url: str) -> str:
    """A listing's number at the end of its URL, else the URL."""
    found = re.search(pattern, url)
    return found[1] if found else url


def at(node, *path):
    for key in path:
        node = node.get(key) if isinstance(node, dict) else None
    return node


def bare(url) -> str:
    return re.split("[?#]", url)[0] if isinstance(url, str) else ""


def residence(o: dict) -> dict | None:
    url = bare(o.get("url"))
    return url and {
        "source_url": url, "source_id": ending(r"-u(\d+)/?$", url), "deal_type": "rent" if "/property-rent/" in url else "sale", "condo_name": o.get("name"),
        "area_sqm": number(at(o, "floorSize", "value")), "bedrooms": number(o.get("numberOfRooms"), int), "district": at(o, "address", "addressLocality"),
        "lat": number(at(o, "geo", "latitude")), "lng": number(at(o, "geo", "longitude")),
    }


def product(o: dict) -> dict | None:
    url, name = bare(at(o, "offers", "url")), o.get("name")
    sku = "" if o.get("sku") is None else str(o["sku"])
    found = re.search(r"(\d+)/?$", url)
    sku = sku or (found[1] if found else "")
    return "/property/bangkok" in url and sku and {
        "source_url": url, "source_id": sku, "condo_name": name, "price": number(at(o, "offers", "price")), "area_sqm": digits(r"(\d+(?:\.\d+)?)\s*(?:sq\.?\s*m|sqm)", name, float),
        "bedrooms": digits(r"(\d+)\s*(?:bedroom|bed)\b", name), "bathrooms": digits(r"(\d+)\s*(?:bathroom|baths?)\b", name),
    }


def listed(o: dict) -> dict | None:
    url, about = bare(o.get("url")), o.get("about")
    return url and {
        "source_url": url, "source_id": url, "condo_name": at(about, "containedInPlace", "name"), "price": number(at(o, "offers", "price")), "bedrooms": number(at(about, "numberOfBedrooms"), int),
        "district": at(about, "address", "addressLocality"), "lat": number(at(about, "geo", "latitude")), "lng": number(at(about, "geo", "longitude")),
    }


def stated(o: dict) -> dict | None:
    url, full = bare(o.get("url")), o.get("fullAddress") if isinstance(o.get("fullAddress"), str) else ""
    parts = [x.strip() for x in full.split(",") if x.strip()]
    return url and full.lower().endswith("bangkok") and {
        "source_url": url, "source_id": ending(r"-(\d+)/?$", url), "condo_name": at(o, "property", "projectName") or o.get("localizedTitle"), "price": number(at(o, "price", "value")),
        "bedrooms": digits(r"(\d+)", str(o.get("bedrooms") or "")), "bathrooms": digits(r"(\d+)", str(o.get("bathrooms") or "")), "district": parts[-2] if len(parts) > 1 else None,
    }


@dataclass(frozen=True)
class Adapter:
    """How a site's list pages hold listings: the pattern of their blocks, what such a block is called, which objects
    count, and what each is as a listing (nothing if it is none)."""

    pattern: str
    marker: str
    chosen: Callable[[dict], bool]
    record: Callable[[dict], dict | None]

    def listings(self, html: str | None) -> Iterator[dict]:
        """The listings of a page, each URL once, the first. What is no JSON, or nested too deep to read, holds none."""
        seen = set()
        for tree in trees(blocks(self.pattern, html or "")):
            for node in walk(tree):
                found = self.record(node) if self.chosen(node) else None
                if found and found["source_url"] not in seen:
                    seen.add(found["source_url"])
                    yield found

    def probe(self, html: str | None) -> tuple[bool, str]:
        """Whether a page is as the adapter expects it, and else what is missing."""
        if not blocks(self.pattern, html or ""):
            return False, f"no {self.marker}: the site's structure has changed, or the page is none of its lists"
        first = next(self.listings(html), None)
        return (True, f"one listing read: {first['source_id']}") if first else (False, f"{self.marker} without a listing")


def typed(kind: str) -> Callable[[dict], bool]:
    return lambda o: o.get("@type") == kind


ADAPTERS = {
    "residences": Adapter(LD_JSON, "structured data", typed("SingleFamilyResidence"), residence),
    "products": Adapter(LD_JSON, "structured data", typed("Product"), product),
    "items": Adapter(LD_JSON, "structured data", typed("RealEstateListing"), listed),
    "state": Adapter(STATE, "embedded state", lambda o: "fullAddress" in o, stated),
}


def row(listing: dict) -> tuple:
    """A listing in the order and types of LISTING; a text where a number belongs, or the other way round, is null."""
    texts = {"source_url", "source_id", "deal_type", "condo_name", "district"}
    return tuple(v if (v := listing.get(f)) is None or isinstance(v, str) == (f in texts) else str(v) if f in texts and not isinstance(v, (dict, list)) else None for f in FIELDS)


# Page by page


@udtf(returnType=LISTING, useArrow=False)
class PageListings:
    """page_listings(source, html): the listings of a page; of an unknown source or a null page none."""

    def eval(self, source: str, html: str):
        adapter = ADAPTERS.get(source)
        for listing in adapter.listings(html) if adapter else ():
            yield row(listing)


def register(spark: SparkSession) -> None:
    """Make the source and the table function known to a session."""
    spark.dataSource.register(ListingPages)
    spark.udtf.register("page_listings", PageListings)


# A folder of pages


class PageFile(InputPartition):
    def __init__(self, source: str, path: str) -> None:
        self.source, self.path = source, path


class Folder:
    """The files of the adapters' folders, in any file system that pyarrow opens by its URI."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        return system, path

    def files(self) -> list[tuple[int, str, str]]:
        """(time, path, source) of each file, the oldest first."""
        from pyarrow import fs

        system, path = self.open()
        out = []
        for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            source = re.search(r"/source=([^/]+)/[^/._][^/]*$", info.path)
            if info.is_file and source:
                out.append((info.mtime_ns or 0, info.path, source[1]))
        return sorted(out)

    def pages(self, path: str) -> Iterator[dict]:
        system, _ = self.open()
        with system.open_input_stream(path, compression="detect") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from trees(lines)
            yield from trees([rest])

    def rows(self, part: PageFile) -> Iterator[tuple]:
        adapter = ADAPTERS.get(part.source)
        for page in self.pages(part.path) if adapter else ():
            for listing in adapter.listings(at(page, "html")):
                yield (part.source, at(page, "url"), *row(listing))


class PageReader(Folder, DataSourceReader):
    def partitions(self) -> list[PageFile]:
        return [PageFile(source, path) for _, path, source in self.files()]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return self.rows(partition)


class ProbeReader(PageReader):
    """The first page of each source alone."""

    def partitions(self) -> list[PageFile]:
        return list({p.source: p for p in reversed(super().partitions())}.values())

    def read(self, partition: PageFile) -> Iterator[tuple]:
        adapter, page = ADAPTERS.get(partition.source), next(self.pages(partition.path), None)
        yield (partition.source, *(adapter.probe(at(page, "html")) if adapter else (False, "no such adapter")))


class PageStream(Folder, DataSourceStreamReader):
    """Offsets are the time and path of the last file read; files must arrive in the order of their times."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[PageFile]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return [PageFile(source, path) for time, path, source in self.files() if low < (time, path) <= high]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return self.rows(partition)


class ListingPages(DataSource):
    """Format listing_pages; with the option probe, a row a source that says whether its pages are as expected."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def probing(self) -> bool:
        return str(self.options.get("probe", "false")).lower() == "true"

    def schema(self) -> str:
        return PROBE if self.probing() else PAGE

    def reader(self, schema) -> DataSourceReader:
        return (ProbeReader if self.probing() else PageReader)(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options["path"])
