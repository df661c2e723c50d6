"""Spellings of one author linked (problem 4).

Names are read into family and given tokens. Tokens, not names, are compared:
suffix blocking indexes the suffixes of each distinct token above a least
length; a suffix that too many tokens have is refined with what stands before
it, less any one letter, so that none is left out and no pair is lost; pairs
within a block are compared by longest-common-subsequence ratio. A token is
replaced by the more frequent one it slipped from. Names that then agree in
family and given name are one author. Nicknames and initials join the only
author they fit; where they fit several, the author decides with whom they share
papers and ORCIDs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import papers
from sheaf.session import cut

SUFFIX = 4  # least length of an indexed suffix
COMMON = 40  # tokens from which a suffix is refined

# fixed values: short forms of given names
NICKNAMES = {
    "alex": "alexander alexandra", "andy": "andrew andreas", "annie": "anne anna", "barb": "barbara", "bea": "beatrice", "bella": "isabella", "ben": "benjamin",
    "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert", "cathy": "catherine katherine", "charlie": "charles", "chris": "christopher christine christian",
    "clarice": "clara", "connie": "constance", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dolly": "dorothea dorothy", "dora": "dorothea", "dot": "dorothea", "ed": "edward",
    "eddie": "edward", "ellie": "eleanor", "fran": "frances francisco", "frank": "francis francisco", "fred": "frederick", "freddie": "frederick", "fritz": "friedrich frederick", "gabi": "gabriela gabriele", "gabe": "gabriel", "gaby": "gabriela",
    "greg": "gregory", "hank": "henry", "hanne": "hannelore", "harry": "henry harold", "iggy": "ignatius", "isa": "isabella isabel", "jack": "john", "jake": "jacob", "jen": "jennifer", "jerry": "gerald", "jim": "james",
    "jo": "josephine joanna", "joe": "joseph jose", "johnny": "john", "jon": "jonathan", "josie": "josephine", "kasia": "katarzyna", "kate": "katherine catherine ekaterina", "kathy": "katherine", "katie": "katherine", "katya": "ekaterina",
    "ken": "kenneth", "larry": "lawrence", "leo": "leonardo leonard", "lena": "helena magdalena", "lisa": "elizabeth", "liz": "elizabeth", "lore": "hannelore", "maggie": "margaret", "marge": "margaret", "masha": "maria", "matt": "matthew", "max": "maximilian",
    "meg": "margaret", "mike": "michael", "mina": "wilhelmina", "minnie": "wilhelmina", "misha": "mikhail", "molly": "mary maria", "nat": "nathaniel", "nate": "nathaniel nathan", "nell": "eleanor penelope", "nick": "nicholas", "paco": "francisco", "pancho": "francisco",
    "pasha": "pavel", "pat": "patricia patrick", "peg": "margaret", "peggy": "margaret", "penny": "penelope", "pepe": "jose", "pete": "peter", "phil": "philip", "rick": "richard", "rob": "robert", "ron": "ronald", "rosie": "rosa", "sally": "sarah",
    "sam": "samuel samantha", "sandy": "alexander alexandra", "sascha": "alexander aleksandr", "sasha": "aleksandr alexander", "sergey": "sergei", "steve": "stephen steven", "sue": "susannah susan", "susie": "susannah", "suzy": "susannah", "ted": "theodore edward", "teddy": "theodore",
    "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tony": "anthony antonio", "uli": "ulrich ulrike", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "wendy": "gwendolen", "will": "william", "willy": "wilhelm william", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
# fixed values: words of organisations, with their short forms
ORGANISATION = {
    "collaboration": "", "consortium": "", "foundation": "", "group": "", "institute": "", "laboratory": "", "laboratories": "laboratory", "network": "", "project": "", "society": "", "team": "", "university": "", "committee": "", "association": "", "initiative": "", "centre": "", "center": "centre", "program": "", "programme": "program", "working": "", "task": "", "force": "", "council": "", "agency": "", "alliance": "", "department": "",
    "wg": "working group", "fdn": "foundation", "found": "foundation", "lab": "laboratory", "labs": "laboratory", "inst": "institute", "collab": "collaboration", "coll": "collaboration", "cons": "consortium", "consort": "consortium", "grp": "group", "univ": "university", "assoc": "association", "soc": "society", "ctr": "centre", "dept": "department",
}
_SURE = {w for w in ORGANISATION} - {"working", "task", "force", "found", "coll", "cons", "team", "project", "soc", "lab", "labs", "center", "program"}
_TITLES = {"jr", "sr", "ii", "iii", "iv", "dr", "prof", "phd", "md", "mr", "mrs", "ms", "et", "al"}
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "’": "'", "‐": "-", "‑": "-", "–": "-"})


def plain(name: str) -> str:
    """Lower case without accents."""
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name).lower().translate(_LETTERS))
    return "".join(c for c in folded if not unicodedata.combining(c))


def _initials(token: str) -> str | None:
    """The letters of a token that is initials (J., J.-L., JL), else None."""
    letters = re.sub(r"[^a-z]", "", token)
    if re.fullmatch(r"(?:[a-z]\.?[-\s]?)", token) or re.fullmatch(r"(?:[a-z]\.-?)+", token) or re.fullmatch(r"[a-z]-[a-z]", token):
        return letters
    return None


def organisation(name: str) -> list[str] | None:
    """Sorted words of an organisation without article, acronym and short forms; None for a person."""
    text = re.sub(r"\([^)]*\)", " ", plain(name))
    text = re.sub(r",?\s*on behalf of.*$|^on behalf of\s+|,?\s*for the\b.*$", " ", text)
    words = re.findall(r"[a-z0-9]+", text)
    ends = "," not in text and len(words) > 2 and (words[-1] in ORGANISATION or words[0] in ORGANISATION)
    if not (any(w in _SURE for w in words) or ends or sum(w in ORGANISATION for w in words) >= 2):
        return None
    out = []
    for w in words:
        out += (ORGANISATION.get(w) or w).split() if w in ORGANISATION else [w]
    return sorted(w for w in out if w not in ("the", "of", "for", "and", "on", "behalf"))


def readings(name: str) -> list[tuple[str, str, str, str]]:
    """Possible (family, its first half, given, initials) of a person; one where a comma or an initial settles the order.

    Family and given are tokens joined by a blank, given being empty where only initials stand.
    """
    if not name.isupper():  # initials without dots
        name = re.sub(r"(?<![\w.])([A-Z]{2,3})(?![\w.])", lambda m: "".join(f"{x}." for x in m[1]), name)
    text = re.sub(r"\([^)]*\)", " ", plain(name)).strip(" ,;")
    if "," in text:
        head, *rest = [x.strip() for x in text.split(",")]
        rest = [x for x in rest if x.strip(" .") not in _TITLES and x]
        if rest:
            return [(_family(head), _part(head), *_given(" ".join(rest)))]
        text = head
    tokens = [t for t in re.split(r"\s+", text) if t.strip(".") not in _TITLES and re.search(r"[a-z]", t)]
    if not tokens:
        return []
    if len(tokens) == 1:
        return [(_family(tokens[0]), _part(tokens[0]), "", "")]
    marks = [_initials(t) is not None for t in tokens]
    if all(marks):
        return [(_family(" ".join(tokens)), "", "", "")]
    if marks[-1]:
        k = max(i for i, m in enumerate(marks) if not m) + 1
        if k == 1:
            return [(_family(tokens[0]), _part(tokens[0]), *_given(" ".join(tokens[1:])))]
        # "Family Given M." or "Family Part I."
        return [(_family(tokens[0]), _part(tokens[0]), *_given(" ".join(tokens[1:]))), (_family(" ".join(tokens[:k])), _part(" ".join(tokens[:k])), *_given(" ".join(tokens[k:])))]
    if any(marks):
        k = max(i for i, m in enumerate(marks) if m) + 1
        return [(_family(" ".join(tokens[k:])), _part(" ".join(tokens[k:])), *_given(" ".join(tokens[:k])))]
    out = [(_family(tokens[-1]), _part(tokens[-1]), *_given(" ".join(tokens[:-1]))), (_family(tokens[0]), _part(tokens[0]), *_given(" ".join(tokens[1:])))]
    if len(tokens) > 2:
        out.append((_family(" ".join(tokens[1:])), _part(" ".join(tokens[1:])), *_given(tokens[0])))
    return out


def _family(text: str) -> str:
    """Letters of a family name; a hyphen or blank inside may slip, so it does not count."""
    return "".join(re.findall(r"[a-z0-9]+", text))


def _part(text: str) -> str:
    """The first half of a hyphenated family name, which some leave the second of away; empty for others."""
    halves = re.split(r"[-\s]", text.strip())
    return _family(halves[0]) if len(halves) == 2 and "-" in text else ""


def _given(text: str) -> tuple[str, str]:
    words, first = [], ""
    for t in re.split(r"\s+", text.strip()):
        letters = _initials(t)
        if letters is None:
            part = re.sub(r"[^a-z]", "", t)
            words += [part] if part else []
            first += part[:1]
        else:
            first += letters
    # umlauts are also written with an e
    return re.sub(r"(?<![qu])ue(?=[a-z]{2})", "u", "".join(words)), first


_READ = pa.schema([("name", pa.string()), ("org", pa.bool_()), ("r", pa.int32()), ("family", pa.string()), ("first_part", pa.string()), ("given", pa.string()), ("initials", pa.string()), ("sure", pa.bool_())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            org = organisation(name)
            if org is not None:
                rows.append((name, True, 0, " ".join(org), "", "", "", True))
                continue
            all_readings = readings(name)
            rows += [(name, False, k, *r, len(all_readings) == 1) for k, r in enumerate(all_readings)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_READ), _READ)], schema=_READ)


def lcs_ratio(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def linked(a: str, b: str) -> bool:
    """Whether the longest-common-subsequence ratio is as high as one slip leaves it: a letter left out or doubled
    makes the shorter token a subsequence of the longer, a swap leaves all letters but one in order."""
    if not (a.isalpha() and b.isalpha()) or abs(len(a) - len(b)) > 1:
        return False
    most = 2 * min(len(a), len(b)) / (len(a) + len(b))
    if len(a) == len(b):
        return lcs_ratio(a, b) >= most - 1 / len(a) - 1e-9 and sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) == 2
    return lcs_ratio(a, b) >= most - 1e-9


def blocks(tokens: DataFrame) -> DataFrame:
    """(role, token, n, ratio, key) of tokens and the blocks they are in.

    Suffixes of SUFFIX letters or more are keys. One that more than COMMON tokens
    have is refined with the letters before it, less any one of them and whole:
    two tokens that differ by a slip before a common suffix have one of these
    keys in common. A slip in the last SUFFIX letters leaves no such suffix; there
    the token less one of its last letters is the key. A refined key is had by no
    more distinct tokens than there are ways to put one letter into it.
    """
    n = F.length("token")
    less = lambda k, upto: F.concat(F.substring("token", F.lit(1), k - 1), F.substring("token", k + 1, upto - k))
    ends = F.concat(F.array(F.col("token")), F.transform(F.sequence(F.greatest(F.lit(1), n - SUFFIX), n), lambda k: less(k, n)))
    base = tokens.where(n >= SUFFIX).select("role", "token", "n", "ratio")
    by_suffix = base.withColumn("q", F.explode(F.sequence(F.lit(SUFFIX), n))).withColumn("key", F.substring("token", -F.col("q"), F.col("q")))
    by_suffix = by_suffix.withColumn("c", F.count("*").over(Window.partitionBy("role", "key"))).where("c > 1")
    head = F.col("q") < n
    heads = F.when(head, F.concat(F.array(F.substring("token", F.lit(1), n - F.col("q"))), F.transform(F.sequence(F.lit(1), F.greatest(n - F.col("q"), F.lit(1))), lambda k: less(k, n - F.col("q"))))).otherwise(F.array(F.lit("")))
    refined = by_suffix.where(F.col("c") > COMMON).select("role", "token", "n", "ratio", F.explode(F.array_distinct(heads)).alias("h"), "key").select("role", "token", "n", "ratio", F.concat(F.lit("r"), "h", F.lit("|"), "key").alias("key"))
    plain = by_suffix.where(F.col("c") <= COMMON).select("role", "token", "n", "ratio", F.concat(F.lit("s"), "key").alias("key"))
    late = base.select("role", "token", "n", "ratio", F.explode(F.array_distinct(ends)).alias("h")).select("role", "token", "n", "ratio", F.concat(F.lit("e"), "h").alias("key"))
    return plain.unionByName(refined).unionByName(late)


def slips(tokens: DataFrame) -> DataFrame:
    """(role, token, canon): tokens that slipped from one at least ``ratio`` times as frequent.

    ``tokens`` has role, token, n and ratio. Tokens of under four letters, and numbers, never slip.
    """
    keyed = blocks(tokens)
    a = keyed.select("role", "key", "token", "n", "ratio")
    b = keyed.select("role", "key", F.col("token").alias("canon"), F.col("n").alias("m"))
    pairs = (
        a.join(b, ["role", "key"])
        .where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("canon") < F.col("token"))))
        .where((F.col("n") * F.col("ratio") <= F.col("m")) & (F.abs(F.length("token") - F.length("canon")) <= 1))
        .select("token", "canon", "role", "m").distinct()
    )
    near = pairs.mapInArrow(_near, "token string, canon string, role string, m long")
    once = near.groupBy("role", "token").agg(F.max_by("canon", F.struct("m", "canon")).alias("canon"))
    # a token that slipped from a slip
    return once.join(once.select("role", F.col("token").alias("canon"), F.col("canon").alias("origin")), ["role", "canon"], "left").select("role", "token", F.coalesce("origin", "canon").alias("canon"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def corrected(df: DataFrame, columns: dict[str, int], keep: list[str] | None = None) -> DataFrame:
    """df, whose column ``name`` is its key, with the blank-separated tokens of each column replaced by
    those they slipped from. columns: how many times as frequent the right token must be."""
    roles = F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.lit(r).alias("ratio"), F.col(c).alias("text")) for c, r in columns.items()]))
    flat = df.select("name", roles.alias("x")).select("name", "x.role", "x.ratio", F.posexplode(F.split("x.text", " ")).alias("p", "token")).where("token <> ''")
    words = flat.where(~F.col("token").isin(keep) | (F.col("role") != "given") if keep else F.lit(True)).groupBy("role", "token", "ratio").agg(F.count("*").alias("n"))
    fixed = flat.join(slips(words), ["role", "token"], "left").groupBy("name", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("canon", "token").alias("t")))), lambda x: x["t"]), " ").alias("new"))
    wide = fixed.groupBy("name").agg(*[F.max(F.when(F.col("role") == c, F.col("new"))).alias(f"_{c}") for c in columns])
    out = df.join(wide, "name", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def linked_names(records: DataFrame) -> DataFrame:
    """(name, author): every distinct string in authors, with the least spelling of the same author.

    Null and blank names are left out. Strings that fit several authors and
    share no paper or ORCID with one of them more than with the others stay alone.
    """
    orcids = "orcids" if "orcids" in records.columns else "cast(null AS map<string,string>) AS orcids"
    one = records.where("record_id IS NOT NULL").selectExpr("record_id", "title", "authors", orcids, "coalesce(added, '') AS added")
    one = one.groupBy("record_id").agg(F.max_by(F.struct("title", "authors", "orcids"), F.struct("added", F.hash("title", "authors"))).alias("v")).select("record_id", "v.*")
    orcid = F.regexp_extract(F.regexp_replace(F.upper(F.try_element_at("orcids", F.col("name"))), r"[^0-9X]", ""), r"(\d{15}[\dX])$", 1)
    occ = one.select("record_id", papers.title_key(F.col("title")).alias("paper"), "orcids", F.explode("authors").alias("name")).where("name IS NOT NULL AND trim(name) <> ''")
    occ = cut(occ.select("record_id", "paper", "name", F.when(orcid != "", orcid).alias("orcid")))
    read = cut(occ.select("name").distinct().mapInArrow(_read, "name string, org boolean, r int, family string, first_part string, given string, initials string, sure boolean"))

    # the order of the tokens, where no comma settles it: families and given names that others have
    surely = read.where("sure AND given <> '' AND NOT org")
    unsure = read.where("NOT sure").join(surely.groupBy("family").agg(F.lit(2).alias("f")), "family", "left").join(surely.groupBy("given").agg((F.count("*") > 1).cast("int").alias("g")), "given", "left")
    score = F.coalesce("f", F.lit(0)) + F.coalesce("g", F.lit(0))
    chosen = unsure.groupBy("name").agg(F.max_by(F.struct("org", "family", "first_part", "given", "initials"), F.struct(score, -F.col("r"))).alias("v")).select("name", "v.*")
    whole = read.where("sure").select("name", "org", "family", "first_part", "given", "initials").unionByName(chosen).withColumn("organisation", F.when(F.col("org"), F.col("family")).otherwise(F.lit(""))).withColumn("family", F.when(F.col("org"), F.lit("")).otherwise(F.col("family")))
    whole = cut(corrected(whole, {"organisation": 1, "family": 1, "given": 5}, keep=sorted(NICKNAMES)))
    orgs = whole.where("org").select("name", F.concat(F.lit("o|"), F.array_join(F.array_sort(F.split("organisation", " ")), " ")).alias("cluster"))
    people = whole.where("NOT org")

    # half of a hyphenated name stands for the whole where the whole has the given name
    halves = people.where("first_part <> '' AND given <> ''").groupBy(F.col("first_part").alias("family"), "given").agg(F.min("family").alias("whole"), F.max("family").alias("other")).where("whole = other")
    people = people.join(halves.drop("other"), ["family", "given"], "left").withColumn("family", F.coalesce("whole", "family")).drop("whole")

    formals = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() for x in (k, v)])
    short_forms = people.withColumn("formal", F.explode(F.split(F.try_element_at(formals, F.col("given")), " "))).select("name", "family", F.col("formal").alias("given"))
    nick_halves = short_forms.join(halves.drop("other"), ["family", "given"]).groupBy("name").agg(F.min("whole").alias("whole"))
    people = people.join(nick_halves, "name", "left").withColumn("family", F.coalesce("whole", "family")).drop("whole")

    # full given names: an author for each family and given name
    people = cut(people.withColumn("formal", F.split(F.try_element_at(formals, F.col("given")), " ")).withColumn("full", (F.col("given") != "") & F.col("formal").isNull()).withColumn("cluster", F.concat_ws("|", F.lit("p"), "family", "given")))
    known = people.where("full").select("family", "given", F.substring("initials", 1, 1).alias("i"), "cluster").distinct()
    # a nickname whose full form the family does not have stands for its first full form
    nick = people.where("formal IS NOT NULL").select("name", "family", "formal", F.substring("initials", 1, 1).alias("i0"))
    found_formal = nick.join(known.select("family", "given", "cluster"), "family").where(F.array_contains("formal", F.col("given"))).select("name", "cluster")
    unknown = cut(nick.join(found_formal.select("name").distinct(), "name", "left_anti").withColumn("cluster", F.concat_ws("|", F.lit("p"), "family", F.col("formal")[0])))
    settled = people.where("full").select("name", "cluster").unionByName(unknown.select("name", "cluster"))
    by_initial = known.select("family", "i", "cluster").unionByName(unknown.select("family", F.explode(F.array("i0", F.substring(F.col("formal")[0], 1, 1))).alias("i"), "cluster")).distinct()
    # initials: the authors of the family they fit
    asked = people.where("NOT full AND formal IS NULL").select("name", "family", F.substring("initials", 1, 1).alias("i0"))
    fits = asked.where("i0 <> ''").join(by_initial.withColumnRenamed("i", "i0"), ["family", "i0"]).select("name", "cluster")
    options = cut(fits.unionByName(found_formal).distinct().withColumn("n", F.count("*").over(Window.partitionBy("name"))))
    single = options.where("n = 1").select("name", "cluster")

    # several: who shares papers (but no record) and ORCIDs with the string
    several = options.where("n > 1").select("name", "cluster")
    theirs = occ.join(settled.unionByName(single), "name").select("cluster", "paper", "record_id", "orcid")
    mine = occ.join(several, "name").select("name", "cluster", "paper", "record_id", "orcid")
    by_paper = mine.where("paper IS NOT NULL").join(theirs.select("cluster", "paper", F.col("record_id").alias("other")), ["cluster", "paper"])
    shared = by_paper.groupBy("name", "cluster", "paper").agg(F.max((F.col("record_id") == F.col("other")).cast("int")).alias("both")).select("name", "cluster", F.when(F.col("both") == 1, -3).otherwise(1).alias("w"))
    by_id = mine.where("orcid IS NOT NULL").join(theirs.where("orcid IS NOT NULL").select("cluster", "orcid").distinct(), ["cluster", "orcid"]).select("name", "cluster", F.lit(2).alias("w"))
    weighed = shared.unionByName(by_id).groupBy("name", "cluster").agg(F.sum("w").alias("w")).where("w > 0")
    decided = weighed.groupBy("name").agg(F.max_by("cluster", F.struct("w", "cluster")).alias("cluster"), F.sort_array(F.collect_list("w"), asc=False).alias("ws")).where(F.coalesce(F.get("ws", F.lit(1)), F.lit(0)) < F.get("ws", F.lit(0))).select("name", "cluster")

    # neither: names of one family with the same initial or no given name
    lone = F.concat_ws("|", F.lit("l"), "family", "i0")
    placed = settled.unionByName(single).unionByName(decided).unionByName(orgs).select("name", "cluster", F.lit(0).alias("rank"))
    undecided = several.select("name", F.concat(F.lit("n|"), F.col("name")).alias("cluster"), F.lit(1).alias("rank"))
    others = asked.select("name", lone.alias("cluster"), F.lit(2).alias("rank"))
    rest = occ.select("name", F.concat(F.lit("n|"), F.col("name")).alias("cluster"), F.lit(3).alias("rank"))
    best = placed.unionByName(undecided).unionByName(others).unionByName(rest).groupBy("name").agg(F.min_by("cluster", F.struct("rank", "cluster")).alias("cluster"))
    return best.withColumn("author", F.min("name").over(Window.partitionBy("cluster"))).select("name", "author")


def found(records: DataFrame) -> DataFrame:
    """Pairs of different spellings of one author; an author has few spellings, whatever the number of records."""
    links = cut(linked_names(records))
    a = links.select("author", F.col("name").alias("name_a"))
    b = links.select("author", F.col("name").alias("name_b"))
    return a.join(b, "author").where("name_a < name_b").select("name_a", "name_b")
