"""Landed job-board feeds and pages to postings."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions import fields as X
from postmill.functions import text as T
from postmill.functions.salary import fill_salary

GREENHOUSE = "jobs array<struct<title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>>>"
LEVER = "struct<text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,additionalPlain:string,categories:struct<location:string,commitment:string,team:string>>"
REMOTEOK = "struct<legal:string,position:string,company:string,location:string,url:string,date:string,description:string,salary_min:bigint,salary_max:bigint,tags:array<string>>"
ASHBY = "jobs array<struct<id:string,title:string,location:variant,department:variant,descriptionHtml:string,descriptionPlain:string,employmentType:string,jobUrl:string,publishedAt:string>>"
WORKDAY = "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>"
AMAZON = "jobs array<struct<title:string,normalized_location:string,location:string,description:string,basic_qualifications:string,job_path:string,posted_date:string,company_name:string>>"
JOBICY = "jobs array<struct<jobTitle:string,companyName:string,jobGeo:string,annualSalaryMin:string,annualSalaryMax:string,jobDescription:string,jobType:variant,url:string,pubDate:string>>"
REMOTIVE = "jobs array<struct<title:string,company_name:string,candidate_required_location:string,salary:string,description:string,tags:array<string>,job_type:string,url:string,publication_date:string>>"


def plain(html: Column) -> Column:
    """Text of an HTML fragment by pattern: enough for feed descriptions."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)<(?:br|/p|/li|/div|/h[1-4])[^>]*>", "\n")
    return T.collapse_ws(T.clean_field(s))


def posting(**columns: Column) -> list[Column]:
    """The columns of a posting in their types; those not given are null, seniority is guessed from the title."""
    names = ("title", "company", "location", "remote", "seniority", "job_type", "team", "description", "url", "posted_date", "salary_text", "technologies", "source")
    kinds = {"posted_date": "timestamp", "technologies": "array<string>"}
    columns.setdefault("seniority", X.guess_seniority(columns["title"]))
    return [columns.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names]


def slug_name(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def remote_of(location: Column) -> Column:
    return F.when(F.contains(F.lower(T.text(location)), F.lit("remote")), "remote").otherwise("unknown")


def from_greenhouse(raw: DataFrame) -> DataFrame:
    """Boards (slug, body: JSON with jobs[]) to postings; descriptions of at most 12,000 characters."""
    j = raw.select("slug", F.explode(F.from_json("body", GREENHOUSE).getField("jobs")).alias("j"))
    place = F.col("j.location.name")
    return j.select(*posting(
        title=F.col("j.title"), company=slug_name(F.col("slug")), location=place, remote=remote_of(place), url=F.col("j.absolute_url"),
        description=F.substring(plain(F.col("j.content")), 1, 12_000), posted_date=F.try_to_timestamp("j.updated_at"), source=F.concat(F.lit("greenhouse:"), F.col("slug")),
    ))


def from_lever(raw: DataFrame) -> DataFrame:
    """Boards (slug, body: JSON array) to postings; the salary is the first line with a dollar sign, of at most 100 characters."""
    j = raw.select("slug", F.explode(F.from_json("body", f"array<{LEVER}>")).alias("j"))
    paid = F.get(F.filter(F.split(T.text(F.col("j.additionalPlain")), "\n"), lambda x: F.contains(x, F.lit("$"))), F.lit(0))
    place = F.col("j.categories.location")
    return j.select(*posting(
        title=F.col("j.text"), company=slug_name(F.col("slug")), location=place, remote=remote_of(place), url=F.col("j.hostedUrl"), description=F.col("j.descriptionPlain"),
        posted_date=F.timestamp_millis("j.createdAt"), salary_text=F.substring(F.trim(paid), 1, 100), source=F.concat(F.lit("lever:"), F.col("slug")),
    ))


def from_remoteok(raw: DataFrame) -> DataFrame:
    """Feed bodies (JSON array whose first row is a legal note) to postings."""
    j = raw.select(F.explode(F.from_json("body", f"array<{REMOTEOK}>")).alias("j")).filter("j.legal is null")
    pay = F.when((F.col("j.salary_min") > 0) & (F.col("j.salary_max") > 0), F.format_string("$%,d-$%,d", "j.salary_min", "j.salary_max"))
    return j.select(*posting(
        title=F.col("j.position"), company=F.col("j.company"), location=F.col("j.location"), remote=F.lit("remote"), url=F.col("j.url"), description=plain(F.col("j.description")),
        posted_date=F.try_to_timestamp("j.date"), salary_text=pay, technologies=F.col("j.tags"), source=F.lit("remoteok"),
    ))


def jobs_of(raw: DataFrame, schema: str, field: str, *keep: str) -> DataFrame:
    """One row j for each entry of the body's list; broken and null bodies give none."""
    return raw.select(*keep, F.explode(F.from_json("body", schema).getField(field)).alias("j"))


def name_of(c: Column) -> Column:
    """A variant that is either plain text or an object with a name."""
    return F.when(F.schema_of_variant(c).startswith("OBJECT"), F.try_variant_get(c, "$.name", "string")).otherwise(F.try_variant_get(c, "$", "string"))


def from_ashby(raw: DataFrame) -> DataFrame:
    """Boards (slug, body) to postings: HTML before plain text, and a board address where a posting has none."""
    j, c = jobs_of(raw, ASHBY, "jobs", "slug"), F.col
    place, some = name_of(c("j.location")), lambda x: F.nullif(F.trim(c(f"j.{x}")), F.lit(""))
    return j.select(*posting(
        title=c("j.title"), company=slug_name(c("slug")), location=place, remote=remote_of(place), job_type=F.coalesce("j.employmentType", F.lit("full-time")),
        team=name_of(c("j.department")), description=F.substring(plain(F.coalesce(some("descriptionHtml"), some("descriptionPlain"))), 1, 12_000),
        url=F.coalesce(some("jobUrl"), F.concat(F.lit("https://jobs.ashbyhq.com/"), c("slug"), F.lit("/"), T.text(c("j.id")))),
        posted_date=F.try_to_timestamp("j.publishedAt"), source=F.concat(F.lit("ashby:"), c("slug")),
    ))


def from_workday(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Boards (tenant, region, board, body) with their detail pages (tenant, path, body); a card without one stays.

    Posting days are relative words, so there is no date.
    """
    j, c = jobs_of(cards, WORKDAY, "jobPostings", "tenant", "region", "board"), F.col
    bare = lambda x: F.regexp_replace(F.trim(T.text(x)), "^/+", "")
    about = F.get_json_object("body", "$.jobPostingInfo.jobDescription")
    pages = details.select("tenant", bare(c("path")).alias("path"), about.alias("about")).filter("path <> ''").groupBy("tenant", "path").agg(F.max("about").alias("about"))
    place = F.trim(T.text(c("j.locationsText")))
    rows = j.withColumn("path", bare(c("j.externalPath"))).join(pages, ["tenant", "path"], "left")
    site = F.concat(F.lit("https://"), c("tenant"), F.lit("."), c("region"), F.lit(".myworkdayjobs.com/"), c("board"), F.lit("/"), c("path"))
    return rows.select(*posting(
        title=F.trim(c("j.title")), company=slug_name(c("tenant")), location=place, remote=remote_of(place), job_type=F.lit("full-time"), url=site,
        description=F.substring(plain(c("about")), 1, 12_000), source=F.concat(F.lit("workday:"), c("tenant")),
    ))


def from_amazon(raw: DataFrame) -> DataFrame:
    """Search pages (page, body) to postings; of equal (title, url) the first found stays, by page and place."""
    c = F.col
    j = raw.select("page", F.posexplode(F.from_json("body", AMAZON).getField("jobs")).alias("i", "j"))
    url = F.concat(F.lit("https://www.amazon.jobs"), T.text(c("j.job_path")))
    first = j.groupBy(T.text(c("j.title")).alias("title"), url.alias("url")).agg(F.min_by("j", F.struct("page", "i")).alias("j"))
    needs = F.substring("j.basic_qualifications", 1, 200)
    return first.select(*posting(
        title=c("title"), company=F.lit("Amazon"), location=F.coalesce(F.nullif("j.normalized_location", F.lit("")), "j.location"), remote=F.lit("unknown"),
        job_type=F.lit("full-time"), team=c("j.company_name"), description=F.substring(plain(c("j.description")), 1, 12_000), url=c("url"),
        posted_date=F.coalesce(F.try_to_timestamp("j.posted_date"), F.try_to_timestamp("j.posted_date", F.lit("MMMM d, yyyy"))),
        technologies=F.when(needs != "", F.array(needs)), source=F.lit("amazon"),
    ))


def from_jobicy(raw: DataFrame) -> DataFrame:
    j, c = jobs_of(raw, JOBICY, "jobs"), F.col
    lo, hi = (c(f"j.annualSalary{x}").try_cast("bigint") for x in ("Min", "Max"))
    pay = F.when((lo > 0) & (hi > 0), F.format_string("$%,d-$%,d", lo, hi))
    return j.select(*posting(
        title=c("j.jobTitle"), company=c("j.companyName"), location=F.coalesce("j.jobGeo", F.lit("Remote")), remote=F.lit("remote"),
        job_type=F.coalesce(name_list(c("j.jobType")), F.lit("full-time")), description=F.substring(plain(c("j.jobDescription")), 1, 12_000),
        url=c("j.url"), posted_date=F.try_to_timestamp("j.pubDate"), salary_text=pay, source=F.lit("jobicy"),
    ))


def name_list(c: Column) -> Column:
    """A variant that is either plain text or a list of texts, comma-joined."""
    return F.when(F.schema_of_variant(c).startswith("ARRAY"), F.array_join(F.try_variant_get(c, "$", "array<string>"), ", ")).otherwise(F.try_variant_get(c, "$", "string"))


def from_remotive(raw: DataFrame) -> DataFrame:
    j, c = jobs_of(raw, REMOTIVE, "jobs"), F.col
    return j.select(*posting(
        title=c("j.title"), company=c("j.company_name"), location=F.coalesce("j.candidate_required_location", F.lit("Remote")), remote=F.lit("remote"),
        job_type=F.coalesce("j.job_type", F.lit("full-time")), description=F.substring(plain(c("j.description")), 1, 500), url=c("j.url"),
        posted_date=F.try_to_timestamp(F.substring("j.publication_date", 1, 10)), salary_text=F.nullif(F.trim("j.salary"), F.lit("")),
        technologies=c("j.tags"), source=F.lit("remotive"),
    ))


def finalize(postings: DataFrame) -> DataFrame:
    """Salary bands from descriptions where a posting has none, and the signature."""
    return fill_salary(postings).withColumn("signature", T.signature())


def source_tallies(postings: DataFrame, errors: DataFrame) -> DataFrame:
    """Jobs and errors of each source, most jobs first. errors: (source, error)."""
    jobs = postings.groupBy("source").agg(F.count(F.lit(1)).alias("jobs"))
    failed = errors.groupBy("source").agg(F.count(F.lit(1)).alias("errors"))
    out = jobs.join(failed, "source", "full_outer").select("source", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("errors", F.lit(0)).alias("errors"))
    return out.orderBy(F.desc("jobs"), F.asc("source"))


def ingest(sources: list[DataFrame]) -> DataFrame:
    """All feeds as one table."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


PIECE_BYTES = 1 << 20
DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button", "iframe", "svg"}
BLOCKS = {"p", "li", "div", "tr", "h1", "h2", "h3", "h4", "br"}


def pieces(batches, column: str, most: int = PIECE_BYTES):
    """Batches cut so that the texts of each piece take ``most`` bytes, or are one single row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class _Page(HTMLParser):
    """Visible text and links of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.links, self.href, self.label = [], 0, [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.depth += 1
        if tag == "br":
            self.out.append("\n")
        if tag == "a":
            self.href, self.label = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCKS:
            self.out.append("\n")
        if tag == "a" and self.href is not None:
            self.links.append((self.href, "".join(self.label).strip()))
            self.href = None

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)
        if self.href is not None:
            self.label.append(data)


def read_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, the columns ``keep``, text (scripts, navigation and the like left out) and links of (page_id, html, ...)."""
    names = ("page_id", *keep)

    def run(batches):
        for b in pieces(batches, "html"):
            texts, links = [], []
            for html in b.column("html").to_pylist():
                p = _Page()
                p.feed(html or "")
                p.close()
                texts.append("".join(p.out))
                links.append([{"href": h, "label": t} for h, t in p.links])
            kind = pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(links, kind)], [*names, "text", "links"])

    base = pages.select(*names, "html")
    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in names)
    return base.mapInArrow(run, f"{schema}, text string, links array<struct<href:string,label:string>>")


def clean_pages(pages: DataFrame, most: int = 8000) -> DataFrame:
    """page_id and text without tracking-code lines and spare white space, of at most ``most`` characters."""
    return read_pages(pages).select("page_id", F.substring(T.collapse_ws(T.drop_tracking_codes(F.col("text"))), 1, most).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href (absolute) and label of each link."""
    host = F.regexp_extract(T.text(F.col("url")), r"^(https?://[^/]+)", 1)
    rows = read_pages(pages, "url").select("page_id", host.alias("host"), F.explode("links").alias("l"))
    return rows.select("page_id", F.when(F.startswith("l.href", F.lit("/")), F.concat("host", "l.href")).otherwise(F.col("l.href")).alias("href"), "l.label")


SELECTOR = re.compile(r"^(?P<tag>[\w-]*)(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)(?:\*=['\"](?P<part>[^'\"]*)['\"])?\])?$")


class _Cards(HTMLParser):
    """Elements that a selector picks: visible text and the first link of each."""

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.want, self.cards, self.open, self.hidden = SELECTOR.match(selector).groupdict(), [], [], 0

    def _picks(self, tag, attrs) -> bool:
        w = self.want
        value = attrs.get(w["attr"]) if w["attr"] else None
        return (not w["tag"] or w["tag"] == tag) and (not w["cls"] or w["cls"] in (attrs.get("class") or "").split()) and (
            not w["attr"] or (w["attr"] in attrs and (w["part"] is None or w["part"] in (value or ""))))

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.hidden += tag in DROPPED
        if tag not in VOID and self._picks(tag, attrs):
            self.cards.append({"text": [], "href": None})
            self.open.append([tag, 0, self.cards[-1]])
        for own in self.open:
            own[1] += own[0] == tag
            if tag == "a" and own[2]["href"] is None:
                own[2]["href"] = attrs.get("href") or None
            if tag == "br":
                own[2]["text"].append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in DROPPED))
        for own in self.open:
            own[1] -= own[0] == tag
            if tag in BLOCKS:
                own[2]["text"].append("\n")
        self.open = [own for own in self.open if own[1] > 0]

    def handle_data(self, data):
        if not self.hidden:
            for own in self.open:
                own[2]["text"].append(data)


def cards_from_html(pages: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """Cards of (page_id, url, html): page_id, card_index, text and url_hint, the card's first link made absolute.

    The first of ``selectors`` (tag.class[attr*='part'], each part optional) that picks anything on a page gives its cards.
    """

    def run(batches):
        for b in pieces(batches, "html"):
            found = []
            for html in b.column("html").to_pylist():
                cards = []
                for selector in selectors:
                    p = _Cards(selector)
                    p.feed(html or "")
                    p.close()
                    cards = [{"card_index": i, "text": "".join(c["text"]), "href": c["href"]} for i, c in enumerate(p.cards)]
                    if cards:
                        break
                found.append(cards)
            kind = pa.list_(pa.struct([("card_index", pa.int32()), ("text", pa.string()), ("href", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, kind)], ["page_id", "url", "cards"])

    base = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    kind = base.schema["page_id"].dataType.simpleString()
    rows = base.mapInArrow(run, f"page_id {kind}, url string, cards array<struct<card_index:int,text:string,href:string>>").select("page_id", "url", F.explode("cards").alias("c"))
    host = F.regexp_extract(T.text(F.col("url")), r"^(https?://[^/]+)", 1)
    hint = F.when(F.startswith("c.href", F.lit("/")), F.concat(host, "c.href")).otherwise(F.col("c.href"))
    return rows.select("page_id", "c.card_index", T.collapse_ws(F.col("c.text")).alias("text"), hint.alias("url_hint"))


MAJOR = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Top-level elements of a fragment: tag, source, text, and the text of a bold first child."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text() or ""
        if tag in VOID:
            if self.depth:
                self.blocks[-1]["html"].append(raw)
            return
        if not self.depth:
            self.blocks.append({"tag": tag, "html": [], "text": [], "bold": [], "children": 0, "in_bold": False})
        block = self.blocks[-1]
        if self.depth == 1:
            block["children"] += 1
            block["in_bold"] = block["children"] == 1 and tag in ("strong", "b")
        block["html"].append(raw)
        self.depth += 1

    def handle_endtag(self, tag):
        if not self.depth or tag in VOID:
            return
        self.depth -= 1
        self.blocks[-1]["html"].append(f"</{tag}>")
        if self.depth <= 1:
            self.blocks[-1]["in_bold"] = False

    def handle_data(self, data):
        if self.depth:
            block = self.blocks[-1]
            block["html"].append(data.replace("&", "&amp;").replace("<", "&lt;"))
            block["text"].append(data)
            if block["in_bold"]:
                block["bold"].append(data)


def _is_section(label: str) -> bool:
    s = " ".join(label.lower().split()).rstrip(":： ")
    return any(s == k or s.startswith((k + " ", k + ":")) for k in K.SECTION_HEADINGS)


def _sections(html: str, most: int) -> str:
    p = _Blocks()
    p.feed(html)
    p.close()
    kept, on = [], False
    for b in p.blocks:
        whole, bold = "".join(b["text"]).strip(), "".join(b["bold"]).strip()
        heading = whole if b["tag"] in MAJOR else bold if b["tag"] in ("p", "div") and len(whole) <= 1.4 * len(bold) else ""
        starts = bool(heading) and _is_section(heading)
        on = starts or (on and b["tag"] not in MAJOR)
        if on:
            kept.append(b)
    if not kept:
        return html
    out, used = [], 0
    for b in kept:
        n = sum(map(len, b["text"]))
        if used + n > most:
            if b["tag"] in MAJOR:
                out.append("".join(b["html"]))
            return "\n".join([*out, "<p>… more in full description</p>"])
        out.append("".join(b["html"]))
        used += n
    return "\n".join(out)


def trim_descriptions(pages: DataFrame, most: int = 800) -> DataFrame:
    """page_id and the sections of html that tell of the role and its requirements, of at most ``most`` visible characters.

    A page without such a section stays whole; a block that would pass the limit ends the text with a note.
    """

    def run(batches):
        for b in pieces(batches, "html"):
            texts = [None if h is None else _sections(h, most) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string())], ["page_id", "html"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, html string")


LOG_BLOCK = 10_000
LOG_HEAD = r"^(\d{4}-\d{2}-\d{2}[ T][0-9:,.]+)\s+\[?(\w+)\]?\s+([\w.]+):?\s+(.*)$"


def read_logs(lines: DataFrame) -> DataFrame:
    """Records of (file, line_no, value): ts, level, logger and message with its continuation lines.

    A line without a head belongs to the head before it in its file. Heads are counted in blocks of ``LOG_BLOCK`` lines, and
    the counts of the blocks before are added, so a long file is not one ordered group.
    """
    from pyspark.sql import Window as W

    head = F.col("value").rlike(LOG_HEAD)
    blocked = lines.withColumn("block", F.floor(F.col("line_no") / LOG_BLOCK))
    own = F.sum(head.cast("int")).over(W.partitionBy("file", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    heads = blocked.groupBy("file", "block").agg(F.sum(head.cast("int")).alias("heads"))  # a row a block
    before = F.coalesce(F.sum("heads").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = blocked.withColumn("own", own).join(heads.select("file", "block", before.alias("before")), ["file", "block"])
    marked = marked.withColumn("record", F.col("own") + F.col("before"))
    message = F.when(head, F.regexp_extract("value", LOG_HEAD, 4)).otherwise(F.col("value"))
    g = marked.filter("record > 0").withColumn("message", message).groupBy("file", "record")
    first = lambda i: F.max(F.when(head, F.regexp_extract("value", LOG_HEAD, i)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "message"))), lambda x: x["message"]), "\n")
    return g.agg(first(1).alias("ts"), first(2).alias("level"), first(3).alias("logger"), body.alias("message"))


LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def tail_logs(records: DataFrame, n: int, min_level: str = "DEBUG") -> DataFrame:
    """The last n records of at least a level, newest first; n counts after the level is applied."""
    rank = T.mapped(F.upper("level"), LOG_LEVELS, F.lit(0))
    return records.filter(rank >= LOG_LEVELS[min_level]).orderBy(F.desc("file"), F.desc("record")).limit(n)


def read_snapshots(spark, folder: str, schema: str, newest: int | None = None) -> DataFrame:
    """Records of the JSON files of a folder, with their file and its time; files that do not parse give none.

    ``newest`` keeps the files last written: files, not rows, are ranked.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_time"))
    if newest is None:
        return rows
    files = rows.select("file", "file_time").distinct().orderBy(F.desc("file_time"), F.desc("file")).limit(newest)
    return rows.join(F.broadcast(files.select("file")), "file", "left_semi")  # at most ``newest`` rows
