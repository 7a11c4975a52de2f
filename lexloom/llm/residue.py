"""Problem 4: template residue, filler, error pages and notices that stand where a policy should be.

Three steps. Trusted labels: a body that consists of error output or notices, of filler, or that holds unfilled blanks
is labelled at once; a text that only speaks of such things, in sentences of its own, is not. Near-duplicates: every
body gets a SimHash of 64 bits over their five-word shingles (of the
text with its numbers and ids masked); bodies that are equal under the mask are one class, and classes that agree in
two of eight blocks of bits meet in one of 28 partitioned tables. Pairs within Hamming distance 6 are verified by
the similarity of their shingles (0.8). What SimHash and its tables miss among bodies with evidence is found by an exact
prefix filter over the shingles, for all classes that are not connected by then. Labels then spread through the connected
components of the verified pairs to members with evidence of the same kind, and from errors, notices and fillers to bodies
without any cue that are verified to be alike, and on from those: these pairs, too, come from the tables and from an exact
prefix filter, in the order of the shingles' hashes, for the tables miss most pairs near the threshold. Of the many bodies
without cues only the keys, and the texts, that can meet what is labelled are shuffled.

Cases: null and empty texts are none; a page of nothing but menus is none; every delivery of a page is a row of its own.
"""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.mainbody import main_text
from lexloom.llm.words import Cues, mixed, shingles, token_hashes
from lexloom.operators.cluster import arrow_map, durable
from lexloom.operators.graph import components
from lexloom.operators.sieve import exploded, passing, sieve

#: What servers and scripts say instead of a page, by sort; whole sentences or lines, lower-cased.
ERROR = r"""
(?:error:? ?)?[45]\d\d\b(?: ?[-:–])?(?: (?:error|page|not found|forbidden|gone|unauthori[sz]ed|bad request|bad gateway|service unavailable|internal server error|gateway time-?out|too many requests|access denied))*
(?:http )?(?:error|status)(?: code)?:? [45]\d\d\b.{0,60}
(?:sorry,? ?)?(?:the |this |that )?(?:page|site|document|address|url|link|resource|file|content)(?: you (?:requested|are looking for|asked for))? (?:was |is |could |can|can[’']t |cannot |does |has |may |might )(?:not |no longer |been |have |be |longer )*(?:found|available|exist|be (?:found|reached|displayed|loaded|broken)|reached|loaded|displayed|moved|removed|deleted|broken|expired).{0,80}
page (?:not found|unavailable|missing|expired)|not found|forbidden|gone|bad (?:gateway|request)|service (?:temporarily )?unavailable|internal server error|gateway time-?out|too many requests(?: \(\d+\))?|access (?:to this (?:page|site|resource) )?(?:has been |is |was )?denied
this site can[’']t be reached|(?:your |the )?(?:session|link|token) (?:has )?expired|(?:oops|whoops|sorry|uh-oh)[!,. ]*(?:something (?:went|has gone) wrong|an error (?:has )?occurred|.{0,60}not found)?|something went wrong|an (?:unexpected |internal )?error (?:has )?occurred.{0,60}
we[’']ll be (?:right )?back(?: soon)?|(?:the site is |we are )?(?:down for |under |planned |scheduled )(?:maintenance|construction).{0,60}|(?:please )?(?:try|come) (?:again|back) later.{0,60}|loading(?: ?\.\.\.|…)?.{0,30}
(?:the )?address \S+ does not exist on this server|you do not have (?:permission|access|the right).{0,80}|log in again to go on|our team has been (?:told|notified|informed).{0,60}|go back to the (?:start|home|main) ?page|(?:ray|request|reference|incident|trace|error|event)(?: ?id)?:? (?:id:? )?[0-9a-f-]{6,40}
err_[a-z_]+|upstream (?:connect|request).{0,80}|(?:fatal|parse|uncaught|syntax|type|reference|runtime|value|key) ?(?:error|exception)\b.{0,120}|traceback \(most recent call last\).*|(?:warning|notice): .{0,60} in .{0,80} on line \d+.*|.{0,40}\bexception in thread\b.*|at [\w.$]+\([\w.]+:\d+\)|stack trace.{0,60}
[{<]["'/a-z].{0,40}\b(?:error|code|status|message|fault|reason)\b.{0,300}[}>]|(?:undefined|null|nan|\[object object\])(?:[ ,]+(?:undefined|null|nan|\[object object\]))*|no such (?:key|file|bucket|page).{0,60}|connection (?:refused|reset|timed out).{0,60}
diese seite (?:wurde|konnte|ist|existiert) nicht .{0,40}|seite nicht gefunden|(?:bitte )?versuchen sie es (?:später )?(?:erneut|noch ?mal|wieder).{0,30}|zugriff verweigert|ein fehler ist aufgetreten.{0,40}|interner serverfehler|wartungsarbeiten.{0,40}
(?:la )?page (?:introuvable|non trouvée|demandée n[’']existe (?:plus|pas))|cette page n[’']existe (?:plus|pas)|accès refusé|une erreur (?:est survenue|s[’']est produite).{0,40}|veuillez réessayer.{0,40}|erreur (?:interne|serveur).{0,30}
(?:la )?página (?:no encontrada|no (?:existe|disponible).{0,20})|acceso denegado|(?:ha ocurrido|se ha producido) un error.{0,40}|(?:por favor,? )?(?:inténtelo|vuelva).{0,30}más tarde|error del servidor
ページが(?:見つかりません|存在しません).{0,20}|お探しのページ.{0,40}|页面(?:不存在|未找到|找不到).{0,20}|(?:找不到|未找到)(?:该)?页面.{0,20}|الصفحة غير موجودة.{0,20}|पृष्ठ नहीं मिला.{0,20}|ไม่พบหน้า.{0,30}
"""
NOTICE = r"""
(?:please |you (?:need|have|must) (?:to )?|to .{0,40}, )?(?:enable|activate|turn on|switch on|allow) (?:scripts?|javascript|cookies|js)\b.{0,100}|.{0,60}\b(?:enable|activate|switch on|turn on) (?:javascript|scripts|cookies)\b.{0,60}
(?:this|the) (?:site|page|app|website) (?:needs|requires) .{0,40}\b(?:javascript|scripts|cookies)\b.{0,60}|(?:java)?scripts? (?:is|are|seems to be) (?:disabled|turned off|off|required|needed|blocked)\b.{0,100}|switch it on and reload
your browser (?:is|does) not support(?:ed)?\b.{0,100}|checking (?:your browser|if the site connection).{0,80}|(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?human.{0,60}|(?:complete|solve) the (?:captcha|check|challenge).{0,60}|just a moment.{0,20}|one more step.{0,30}|please wait.{0,60}
(?:bitte )?(?:aktivieren|erlauben) sie (?:javascript|cookies|skripte).{0,80}|javascript (?:ist|muss) .{0,60}|(?:veuillez )?(?:activer|activez|autoriser) (?:javascript|les cookies|les scripts).{0,80}|(?:por favor,? )?(?:active|habilite|permita) (?:javascript|las cookies|los scripts).{0,80}
javascript(?:を|が).{0,30}|(?:请)?(?:启用|开启) ?javascript.{0,30}
"""
FILLER = r"""
.*\binsert (?:your )?(?:own )?(?:text|copy|content|name)\b.*|.*\b(?:placeholder|dummy|sample|filler|example) (?:text|copy|paragraph|content|sentence|page)\b.*|.*\bto be replaced\b.*|(?:text goes here ?)+.{0,12}|.*\b(?:text|content|copy) (?:goes|comes|to come) here\b.*
(?:todo|tbd|tk|fixme)\b.*|lorem ipsum.*|(?:your |a )?(?:headline|heading|title|page title|subtitle) here.*|.*\breplace .{0,60} with (?:real|your|the actual|final)\b.*|(?:coming soon|under construction)\b.{0,40}|(?:click|double-click) (?:here )?to (?:edit|add)\b.*|this is (?:a|an|your) (?:sample|example|placeholder)\b.*
.*\b(?:platzhalter|blindtext|mustertext|beispieltext)\b.*|ihr text\b.*|hier steht ihr text.*|.*\btexte (?:provisoire|factice|de remplissage|d[’']exemple)\b.*|.*\bà remplacer\b.*|votre texte ici.*|.*\btexto (?:de relleno|provisional|de ejemplo|de muestra)\b.*|su texto aquí.*|.*\ba reemplazar\b.*
"""
#: Stems of the words filler in Latin is made of.
LATIN = tuple("lorem ipsum dolor sit amet consect adipis elit sed eiusm tempor incidi labore magna aliqua vestib congu felis ligul platea tempus vitae gravid augue sapi velit porta facil tinci condim rutrum arcu nunc eges varius erat massa tellu cursus morbi orci neque rhon scel mollis quis ultra pretium lectus libero justo metus semper nulla vel ornare pulvin turpis mauris donec pellen fusce suspen viverr maecen phasel curabi vivamu integer praese aenean quisqu nullam dapibu blandi sodale hendre malesu faucib accums bibend eleife dignis sollic volutp tristi commod laoreet imperd interd matti posuer ullamc vehicu venena euismo habita senect netus risus ante urna odio diam nisi nisl purus lacus enim etiam ut at et in ac".split())
#: Blanks to be filled in, by the sign that each begins with.
BLANKS_BY_SIGN = (
    ("{", r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,40}\}|\{[A-Za-z][\w .-]{1,40}\}"),
    ("[", r"\[[A-Za-z_][^\]\[\n(){}=;]{1,50}\](?!\()"),
    ("@@", r"@@[^@\n]{1,50}@@"),
    ("__", r"__[A-Z][A-Z_ .]{1,40}?__|(?<!\w)_{5,}(?!\w)"),
    ("<", r"<%=?[^%<>\n]{1,60}%>|<<[^<>\n]{1,50}>>|<(?!/|https?:|(?i:a|p|b|i|u|s|br|hr|div|span|em|ul|li|ol|td|tr|th|tt|html|body|table|error|code|requestid|message|strong|h\d)\b)[A-Za-z][A-Za-z_ .]{2,40}>"),
    ("%", r"%[A-Z_a-z]{3,40}%|%%[^%\n]{2,40}%%"),
    ("#", r"#[A-Za-z][\w. ]{2,40}#"),
    ("«", r"«(?:[A-Z][A-Z_ ]{3,40}|[a-z]+(?:[_.][a-z_.]+|[A-Z]\w*)|(?i:(?:company|legal|your|insert|effective|retention|contact|state|brand|product|site|business|owner|client|customer|user)\b[\w. ]{0,40}))»"),
    ("*|", r"\*\|[A-Z_:]{2,40}\|\*"),
    ("$", r"\$[A-Z][A-Z_]{2,40}\$"),
    ("(", r"%\([a-z_]{2,40}\)s"),
    ("XXXX", r"(?<!\w)X{4,}(?!\w)"),
)
_BLANKS = [(sign, re.compile(pattern)) for sign, pattern in BLANKS_BY_SIGN]
#: What a program leaves in place of a value that it has not; two of them are blanks.
NOTHINGS = ("undefined", "(null)", "[object object]", "tbd", "nan")
_NOTHING = re.compile(r"(?<![\w.=!<>])(?:undefined|\(null\)|\[object object\]|tbd|nan)(?![\w=;()])")

ERRORS, NOTICES, FILLERS, BLANKS = "error", "notice", "filler", "blanks"
_SORTS = [(ERRORS, re.compile("|".join(f"(?:{x})" for x in ERROR.strip().split("\n")))), (NOTICES, re.compile("|".join(f"(?:{x})" for x in NOTICE.strip().split("\n")))), (FILLERS, re.compile("|".join(f"(?:{x})" for x in FILLER.strip().split("\n"))))]
_PARTS = re.compile(r"\n|(?<=[.!?。！？])\s+|\s[|–—]\s")
#: One of these stands in each error, notice or filler; a part without any is not tried.
_CUES = Cues(tuple("error|go back to|not found|not be found|not exist|javascript|enable scripts|allow scripts|scripts could| scripts are| script is|your browser|denied|expired|wrong|please wait|loading|try again|versuchen sie|forbidden|bad gateway|unavailable|server error|this server|timed out|refused|too many|undefined|[object|traceback|exception|upstream|reached|be right back|maintenance|insert |placeholder|dummy|filler|sample text|sample para|sample cop|sample page|sample content|example text|example page|is an example|to be replaced|goes here|text here|todo|tbd|lorem|headline|title here|with real|platzhalter|blindtext|mustertext|beispieltext|ihr text|provisoire|factice|remplacer|introuvable|n'existe|n’existe|no encontrada|relleno|reemplazar|見つかり|存在しません|不存在|未找到|找不到|غير موجودة|नहीं मिला|ไม่พบ|{\\\"|<error|human|captcha|coming soon|under construction|click to|seite nicht|nicht gefunden|404|bad request|null|(nan)|object object|whoops|oops|err_|warning:|notice:|time-out|bientôt|fixme|status code|just a moment|one more step|switch it on|no such|fatal|stack trace|cookies aktivieren|skripte|activez|active javascript|habilite|permita|启用|开启|ray id|request id|reference id|incident id|come back later|back soon|log in again|our team has been|zugriff|wartungs|accès refusé|réessayer|más tarde|votre texte|su texto|this is your|click here|double-click|editable|tk |404 | gone|access denied|access to th|acceso denegado|do not have|session has|may be broken|been moved|{\"|rate limit|einfehler|ein fehler|serverfehler|une erreur|erreur interne|erreur serveur|erreur du|replace the|replace this|this is an example|this is a sample|this is a placeholder|ページが|お探しの|null null|timeout".split("|")))
#: Words of a sentence that speaks of a placeholder and does not leave one.
_MENTION = re.compile(r"\b(?:fields?|marks?|placeholders?|variables?|scripts?|templates?|tags?|forms?|stands? for|replaced by|write|type|codes?|syntax|brackets|token|feld|platzhalter|champ|campo|balise)\b", re.I)
#: A body is residue if this part of its characters is.
SHARE = 0.5


def evidence(body: str) -> tuple[str, str]:
    """(trusted label or '', weak evidence or '') of a main body."""
    if not body or body.isspace():
        return "", ""
    low = body.lower()
    found = _blanks(body, low)
    mass = {ERRORS: 0, NOTICES: 0, FILLERS: 0}
    total, first = 0, ""
    if _CUES.within(low):
        for raw in _PARTS.split(low):
            part = raw.strip(" \t\r\xa0#*!|-_.…")
            part = part[1:].lstrip() if part.startswith(">") else part
            if not part:
                continue
            total += len(part)
            if _CUES.within(part):
                for name, pattern in _SORTS:
                    if pattern.fullmatch(part):
                        mass[name] += len(part)
                        first = first or name
                        break
    words = low.split()
    latin = _latin(words)
    residue = sum(mass.values())
    label = ""
    if total and residue >= SHARE * total or first and first != FILLERS and residue >= 0.25 * total and total < 400:
        label = max(mass, key=mass.get)
        if mass[FILLERS] and label != FILLERS and mass[FILLERS] > 0.3 * residue:
            label = FILLERS
    elif latin > 0.6 * len(words) and len(words) > 5 or total and latin > 0.3 * len(words) and mass[FILLERS] + 6 * latin > SHARE * total:
        label = FILLERS
    elif any(not mention for mention in found):
        label = BLANKS
    weak = label or (BLANKS if found else max(mass, key=mass.get) if residue else FILLERS if latin > 0.25 * len(words) else "")
    return label, weak


def _blanks(body: str, low: str) -> list[bool]:
    """For each unfilled blank, whether its sentence only speaks of it. A third one, or a second value that a program had not, settles that it does not."""
    out = []
    if any(x in low for x in NOTHINGS) and len(_NOTHING.findall(low)) > 1:
        return [False]
    for m in (m for sign, pattern in _BLANKS if sign in body for m in pattern.finditer(body)):
        if len(out) == 2:
            return [False]  # several are no mention
        a = max(body.rfind("\n", 0, m.start()), body.rfind(". ", 0, m.start())) + 1
        stops = [x for x in (body.find("\n", m.end()), body.find(". ", m.end())) if x >= 0]
        out.append(_MENTION.search(body[a : m.start()] + " " + body[m.end() : min(stops, default=len(body))]) is not None)
    return out


_STEMS = frozenset(x[:4] for x in LATIN if len(x) > 3)


def _latin(words: list[str]) -> int:
    """How many of the words are the Latin of fillers."""
    if sum(map(_STEMS.__contains__, [w[:4] for w in words])) < 0.2 * len(words):
        return 0
    return sum(1 for w in words if w.startswith(LATIN) and w.strip(".,;:!?").isascii())


def is_residue(body: str) -> bool:
    return bool(evidence(body)[0])


SIZE, BLOCKS, NEAR, ALIKE = 5, 8, 6, 0.8  #: hashes within NEAR bits agree in at least BLOCKS - NEAR blocks


def simhash(features: np.ndarray) -> int:
    """SimHash of 64 bits: the sign of each bit's votes."""
    if not len(features):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(mixed(features)).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(features)).view(">u8")[0])


def features(body: str) -> np.ndarray:
    """Different shingles of a body's tokens, numbers and ids masked; a body of fewer than SIZE tokens has one of all its tokens."""
    h = token_hashes(body)
    return np.unique(shingles(h, min(SIZE, max(1, len(h)))))


def judged(df: DataFrame) -> DataFrame:
    """tbl, row_id, label, weak, class_id, simhash, size and prefix (of the features), body (where there is evidence) of the rows of ``df`` (tbl, row_id, text) with a main body."""
    names = ["tbl", "row_id", "label", "weak", "class_id", "simhash", "size", "prefix", "body"]

    def run(batches):
        for b in batches:
            keep, label, weak, ids, hashes, texts, sizes, first = [], [], [], [], [], [], [], []
            for n, text in enumerate(b.column(2).to_pylist()):
                body = main_text(text or "")
                f = features(body)
                if len(f):
                    a, w = evidence(body)
                    keep.append(n)
                    label.append(a)
                    weak.append(w)
                    texts.append(body if w else None)
                    ids.append(class_of(f))
                    hashes.append(simhash(f) - 2**63)
                    sizes.append(len(f))
                    first.append(f[: prefix_size(len(f))])
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(label, pa.string()), pa.array(weak, pa.string()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), _lists(first), pa.array(texts, pa.string())], names)

    return arrow_map(df.select("tbl", "row_id", "text"), run, "tbl string, row_id bigint, label string, weak string, class_id bigint, simhash bigint, size int, prefix array<bigint>, body string")


def _lists(hashes: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64)))


def prefix_size(size: int) -> int:
    """How many of ``size`` features, the first in an order that all sets share, hold one of any set of similarity ALIKE."""
    return size - math.ceil(ALIKE * size - 1e-9) + 1


def class_of(f: np.ndarray) -> int:
    """A key of the bodies that have the same features."""
    return int(np.bitwise_xor.reduce(mixed(f)) + np.uint64(len(f))) - 2**63


#: Farthest neighbour in SimHash order that a class is compared with in a table's bucket.
FARTHEST = 64
#: Classes of a shingle's bucket that are compared in one piece; larger buckets are compared block against block.
BLOCK = 256


def near_pairs(classes: DataFrame) -> DataFrame:
    """a, b (class ids): verified near-duplicates among ``classes`` (class_id, simhash, body); their components are those of all pairs of similarity ALIKE.

    SimHash finds most links with little work; then every other pair that can be similar is tested, unless links already
    verified connect it, so that it can change no component.
    """
    linked = durable(simhash_pairs(classes))
    return linked.unionByName(missing_pairs(classes, components(linked, "a", "b")))


def table_keys() -> Column:
    """The keys of a ``simhash`` in the 28 tables: two of its eight blocks of bits each."""
    block = [F.shiftrightunsigned("simhash", 64 // BLOCKS * k).bitwiseAND((1 << 64 // BLOCKS) - 1) for k in range(BLOCKS)]
    return F.array(*(F.xxhash64(F.lit(t), *(block[k] for k in chosen)) for t, chosen in enumerate(itertools.combinations(range(BLOCKS), BLOCKS - NEAR))))


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """a, b: verified pairs of neighbours in 28 tables, keyed by two of eight blocks of the SimHash's bits; some of all pairs, not all."""
    rows = classes.select("class_id", "simhash", F.explode(table_keys()).alias("key"))
    order = Window.partitionBy("key").orderBy("simhash", "class_id")
    strides = (1, 2, 4, 8, 16, 32, FARTHEST)
    linked = rows.select("class_id", "simhash", *(F.struct(F.lag("class_id", s).over(order).alias("id"), F.lag("simhash", s).over(order).alias("h")).alias(f"n{s}") for s in strides))
    pairs = linked.select("class_id", "simhash", F.explode(F.array(*(f"n{s}" for s in strides))).alias("n")).where("n.id is not null and n.id != class_id")
    close = F.bit_count(F.col("simhash").bitwiseXOR(F.col("n.h"))) <= NEAR
    return verified(pairs.where(close).select(F.least("class_id", "n.id").alias("a"), F.greatest("class_id", "n.id").alias("b")).distinct(), classes)


def missing_pairs(classes: DataFrame, member: DataFrame) -> DataFrame:
    """a, b: all verified pairs of ``classes`` in different components of ``member`` (node, component).

    Exact, by prefix filter: of two sets of similarity ALIKE, each has one of the other's rarest shingles among its own
    rarest. Buckets that lie within one component are dropped; of the others all pairs meet, large ones block by block.
    """
    known = classes.select("class_id", "body").join(member.withColumnsRenamed({"node": "class_id"}), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    sets = durable(_sets(known))
    counted = sets.join(sets.groupBy("h").agg(F.count("*").alias("n")), "h")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("n", "h")) - 1
    first = counted.withColumn("place", place).where((F.col("place") <= F.col("size") - F.ceil(ALIKE * F.col("size") - 1e-9)) & (F.col("n") > 1)).drop("n")
    prefix = durable(first)
    mixed_buckets = prefix.groupBy("h").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    held = prefix.join(mixed_buckets.select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "h").withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    names = ["class_id", "component", "size", "place"]
    x = held.select("h", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"{c}_x") for c in names))
    y = held.select("h", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{c}_y") for c in names))
    once = (F.col("i") < F.col("j")) | (F.col("class_id_x") < F.col("class_id_y"))
    need = F.ceil(F.lit(ALIKE / (1 + ALIKE)) * (F.col("size_x") + F.col("size_y")) - 1e-9)
    reach = F.least("place_x", "place_y") + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= need
    met = x.join(y, ["h", "i", "j"]).where(once & (F.col("component_x") != F.col("component_y")) & reach)
    return verified(met.select(F.least("class_id_x", "class_id_y").alias("a"), F.greatest("class_id_x", "class_id_y").alias("b")).distinct(), classes)


def _sets(known: DataFrame) -> DataFrame:
    """class_id, component, size, h: a row for each different shingle of ``known`` (class_id, body, component)."""

    def run(batches):
        for b in batches:
            sets = [features(x) for x in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            rows = pa.array(np.repeat(np.arange(len(sets), dtype=np.int32), sizes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["class_id", "component", "size", "h"])

    return arrow_map(known.select("class_id", "body", "component"), run, "class_id bigint, component bigint, size int, h bigint")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have the similarity ALIKE."""
    texts = classes.select("class_id", "body")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches):
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = features(x), features(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                fine.append(common >= ALIKE * (len(p) + len(q) - common))
            mask = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return arrow_map(both.select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def candidates(known: DataFrame, rows: DataFrame, done: DataFrame) -> DataFrame:
    """a (of ``known``: class_id, label, simhash, size, prefix), b, weak (of ``rows``, without those in ``done``: class_id, weak): all pairs that can have the similarity ALIKE and whose label may spread; a table.

    SimHash's tables give most with little work, the prefixes of features all. Of the keys of ``rows`` only those
    that ``known`` has are shuffled, told by a table of bits, which may let others pass but keeps back none."""
    sides, sent = [], []
    for key in (table_keys(), F.col("prefix")):
        x = known.select(F.col("class_id").alias("a"), "label", F.col("simhash").alias("ha"), F.col("size").alias("size_a"), F.explode(key).alias("key"))
        sent.append(rows.sparkSession.sparkContext.broadcast(sieve(x.select("key"))))
        y = exploded(rows.select("class_id", "weak", F.col("simhash").alias("hb"), "size", key.alias("key")), sent[-1]).distinct()
        new = y.join(done, ["class_id", "weak"], "left_anti").withColumnRenamed("class_id", "b")
        sides.append(new.join(x, "key").where("weak = '' or weak = label").where(F.least("size", "size_a") >= ALIKE * F.greatest("size", "size_a") - 1e-9))
    tables = sides[0].where(F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= NEAR)
    met = durable(tables.select("a", "b", "weak").unionByName(sides[1].select("a", "b", "weak")).distinct())
    for x in sent:
        x.destroy()
    return met


def reached(rows: DataFrame, df: DataFrame, labelled: DataFrame) -> DataFrame | None:
    """class_id, weak, label of the classes among ``rows`` (``judged`` of ``df``) that are alike ``labelled`` (class_id, label) ones, or alike those, and so on.

    What holds no cue of its own, and what has evidence of the label's kind but is not among ``labelled``, meets the classes of
    errors, notices and fillers; blanks are left out, as the policy with its blanks filled in is a near-duplicate of the form.
    Texts are read again for what meets alone. Each round starts from what the last one reached; most data needs one."""
    firsts = [F.first(x).alias(x) for x in ("simhash", "size", "prefix", "body")]
    rows = rows.drop("label")
    known = durable(rows.where(F.col("weak").isin(ERRORS, NOTICES, FILLERS)).join(labelled, "class_id").groupBy("class_id", "label").agg(*firsts))
    left = rows.where(F.col("weak").isin("", ERRORS, NOTICES, FILLERS))
    done = labelled.select("class_id", F.col("label").alias("weak"))
    out = None
    while True:
        met = candidates(known, left, done)
        if met.isEmpty():
            return out
        one = durable(left.join(met.select(F.col("b").alias("class_id"), "weak").distinct(), ["class_id", "weak"], "left_semi").groupBy("class_id").agg(F.min(F.struct("tbl", "row_id")).alias("k")).select("class_id", "k.tbl", "k.row_id"))
        bodies = _bodies(df, one)
        texts = known.select("class_id", "body").dropDuplicates(["class_id"])
        pairs = verified(met.select("a", "b").distinct(), bodies.select("class_id", "body").unionByName(texts.join(bodies, "class_id", "left_anti")))
        named = pairs.join(met, ["a", "b"]).join(known.select(F.col("class_id").alias("a"), "label"), "a").where("weak = '' or weak = label")
        new = durable(named.groupBy(F.col("b").alias("class_id"), "weak").agg(F.min("label").alias("label")))
        if new.isEmpty():
            return out
        out = new if out is None else out.unionByName(new)
        known = durable(new.select("class_id", "label").distinct().join(bodies, "class_id"))
        done = done.unionByName(new.select("class_id", "weak"))


def _bodies(df: DataFrame, one: DataFrame) -> DataFrame:
    """class_id, simhash, size, prefix, body (the main body) of the rows of ``df`` (tbl, row_id, text) that ``one`` (class_id, tbl, row_id) names; a table. No other text is shuffled."""
    key = F.xxhash64("tbl", "row_id").alias("key")
    sent = df.sparkSession.sparkContext.broadcast(sieve(one.select(key)))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(passing(sent.value, b.column(3).to_numpy())))
            bodies = [main_text(x or "") for x in b.column(2).to_pylist()]
            sets = [features(x) for x in bodies]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([simhash(f) - 2**63 for f in sets], pa.int64()), pa.array(map(len, sets), pa.int32()), _lists([f[: prefix_size(len(f))] for f in sets]), pa.array(bodies, pa.string())], ["tbl", "row_id", "simhash", "size", "prefix", "body"])

    texts = arrow_map(df.select("tbl", "row_id", "text", key), run, "tbl string, row_id bigint, simhash bigint, size int, prefix array<bigint>, body string")
    bodies = durable(texts.join(one, ["tbl", "row_id"]).select("class_id", "simhash", "size", "prefix", "body"))
    sent.destroy()
    return bodies


def residue(df: DataFrame) -> DataFrame:
    """tbl, row_id, label, how ('trusted' or 'spread') of the residue among the rows of ``df`` (tbl, row_id, text)."""
    rows = durable(judged(df))
    marked = rows.where("weak != ''")
    classes = durable(marked.groupBy("class_id").agg(F.first("simhash").alias("simhash"), F.first("body").alias("body")))
    member = durable(components(near_pairs(classes), "a", "b").withColumnsRenamed({"node": "class_id"}))
    known = marked.select("class_id", "tbl", "row_id", "label", "weak").join(member, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    labels = durable(known.where("label != ''").select("component", F.col("label").alias("weak")).distinct())
    both = known.join(labels.withColumn("spread", F.lit(True)), ["component", "weak"], "left").where("label != '' or spread")
    found = both.select("tbl", "row_id", F.when(F.col("label") != "", F.col("label")).otherwise(F.col("weak")).alias("label"), F.when(F.col("label") != "", "trusted").otherwise("spread").alias("how"))
    labelled = durable(both.where(F.col("weak").isin(ERRORS, NOTICES, FILLERS)).select("class_id", "component").distinct().join(labels.where(F.col("weak").isin(ERRORS, NOTICES, FILLERS)).withColumnRenamed("weak", "label"), "component").select("class_id", "label").distinct())
    near = reached(rows, df, labelled)
    return found if near is None else found.unionByName(rows.join(near.withColumnRenamed("label", "spread"), ["class_id", "weak"]).where("label = ''").select("tbl", "row_id", F.col("spread").alias("label"), F.lit("spread").alias("how")))
