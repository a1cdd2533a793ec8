"""Problem 5: personal information in free text, found and replaced by typed placeholders.

Plan
----
1. One Arrow pass per table proposes candidate spans with wide patterns and lets labelers vote on each:
   *format* (a strict pattern of the type), *gazetteer* (public first names, surnames, surname endings, top-level
   domains), *context* (words or JSON keys around it that announce the type) and *contra* (words that announce
   something else: tickets, batches, traces, versions, dates).  No list is a gate: any run of capitalised
   words and any Chinese run beside a name's context is proposed.  Texts never leave the pass; only
   candidates do, one row a text (a few numbers and feature hashes each).
2. Weak supervision: votes are counted per pattern of votes (at most 3**4 patterns a type, whatever
   the data), and expectation-maximisation estimates each labeler's reliability and each pattern's
   probability of being real.
3. A span classifier (logistic regression over votes, shape, the words of a name and neighbouring words) is
   trained on these soft labels, on at most TRAIN_SPANS candidates chosen by hash, and decides every candidate.
   Of overlapping candidates that pass the most probable stays.
4. ``redact`` runs the same proposals with the trained classifier and writes placeholders.

Defined results: null and empty texts have no mentions; of overlapping mentions the most probable stays, then
the earlier and longer one, a name inside an email address is none; offsets count code points of the
stored string; a row delivered twice counts once; tables without candidates give empty results.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import materialize, ship

KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELERS = ("format", "gazetteer", "context", "contra")
#: Bound of the candidates on which the classifier is trained; everything else covers all rows.
TRAIN_SPANS = 20_000
DIM = 1 << 14
THRESHOLD = 0.5

# Gazetteers of common first names and of surnames and their endings, from public name statistics.
FIRST_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret "
    "andrew emily joshua emma kevin olivia brian sophia george mia edward amelia oliver grace jack alice henry lucy oscar clara owen julia "
    "peter maria anna paul laura martin eva stefan petra andreas sabine klaus heike jürgen ursula lukas lena jonas hannah felix greta emil karin "
    "josé juan luis carlos antonio manuel francisco javier diego pablo rafael hugo mateo carmen isabel ana elena sofía sofia lucía marta paula pilar rosa inés "
    "budi siti agus sri dewi putri wati ahmad muhammad mohammed fatima aisha ali omar hassan yusuf ibrahim amina samir leila priya raj arjun anita sanjay deepa "
    "wei li min hiroshi yuki ji hyun olga ivan natalia dmitri tomas jan bruno giulia marco luca pierre marie jean claire lars ingrid erik freya".split()
)
_COMPOUND = "欧阳|上官|司马|司徒|诸葛|东方|夏侯|皇甫|尉迟|慕容|公孙|令狐|轩辕|长孙|宇文|端木|呼延|南宫|西门|独孤|闻人|赫连|澹台|钟离|鲜于|申屠|百里|东郭|万俟|拓跋"
SURNAMES_ZH = (
    f"(?:{_COMPOUND}|"
    "[王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤])"
)
#: Function words and words that open letters; no name starts or ends with one.
_FUNCTION = frozenset(
    "the a an and or of to in on at by for from with is are was were be it its this that these those i you he she we they my your his her our their who what which when where how if then since because as not no yes please "
    "all any each every some new old after before during under over once both can do did does has have will should must may "
    "der die das den dem des ein eine einen und oder von zu mit ist sind war im in am an auf für bei nach aus um wenn als nicht kein alle ich sie wir es bitte wer wie wo was "
    "el la los las un una y o de del al en con por para es son fue se su que si no sí como cuando donde quién qué todos "
    "yang di ke dari dan atau untuk dengan ini itu pada oleh tidak jika siapa apa tolong bila setelah sebelum semua".split()
)
_GREETING = frozenset("signed regards thanks dear hi hello best sincerely cheers mr mrs ms dr prof sr sra señor señora herr frau bapak ibu pak bu atentamente saludos grüße salam hormat".split())
#: Words of places, which streets and towns have and persons rarely.
_PLACE = frozenset("street st road rd avenue ave lane ln drive boulevard blvd court ct square sq terrace box apt flat suite unit floor calle avenida plaza paseo camino jalan jl kota kabupaten straße strasse rue via platz".split())

_FULL = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}

_AT = r"(?:@|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{{0,62}}[A-Za-z0-9])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")
_EMAIL_STRICT = re.compile(r"[A-Za-z0-9._%+'-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\Z")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_#/.+-])(?:\+ ?|\()?\d[\d ().-]{5,24}\d(?:-?[A-Za-z])?(?![A-Za-z0-9_])(?!\.\d)")
_DOCNO = re.compile(r"(?<![A-Za-z0-9_#/.+-])(?:[A-Z]\d{2}[A-Z0-9]{6,8}|[A-Z]{1,3}\d{6,9}|[XYZ]-?\d{7}-?[A-Z])(?![A-Za-z0-9_])")
_PHONE_STRICT = re.compile(
    r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+?1?[2-9]\d{2}[2-9]\d{6}|(?:\+?86[ -]?)?1\d{2}[ -]?\d{4}[ -]?\d{4}|(?:\+?62[ -]?|\(?0)8\d{2}\)?[ -]?\d{3,4}[ -]?\d{3,5}"
    r"|(?:\+?34[ -]?)?[6789]\d{2}(?:[ -]?\d{3}[ -]?\d{3}|(?:[ -]\d{2}){3})|(?:\+?49[ -]?(?:\(0\) ?)?|\(?0)\d{2,4}\)?[ /-]?\d{3,8}(?:[ -]\d{2,5})?|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}\Z"
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CODE = re.compile(r"(?<![A-Za-z0-9_#/.+-])(?=[A-Z]*\d)(?=(?:[A-Z]*\d){4})[A-Z0-9]{7,18}(?![A-Za-z0-9_])")
_ID_STRICT = re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}([- ])\d{2}\1\d{4}|\d{16}|\d{17}[\dXx]|\d{8}-?[A-Za-z]|\d{2}\.\d{3}\.\d{3}-?[A-Za-z]|[A-Z]\d{2}[A-Z0-9]{6,8}|[XYZ]-?\d{7}-?[A-Z]")
_NOT_NUMBER = re.compile(r"\d{4}-\d{2}-\d{2}|\d{4}-\d{2}-\d{4}|\d{3}-\d{4}-\d{2}|\d{1,8}|\d{19,}|\d+\.\d+|(?:19|20)\d{6,12}|\d{1,3}(?:\.\d{1,3}){3}")
_CAP = r"[A-ZÀ-Þ][\wÀ-ÿ'’-]*"
_ADDRESS = (
    # (box) (flat,) number, street word, city and code
    re.compile(
        rf"\b(?:P\. ?O\. ?|PO )Box \d+(?:, {_CAP}(?: {_CAP})?(?: [A-Z]{{2}} \d{{4,6}})?)?"
        rf"|\b(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) [\w-]+, )?\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}} (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Close|Crescent)\b\.?"
        rf"(?:, (?:Apt\.?|Suite|Unit|Flat|Floor|Room) [\w-]+)?(?:, {_CAP})?(?:,? [A-Z]{{2}} \d{{4,6}}(?:-\d{{4}})?)?",
    ),
    re.compile(
        rf"\b(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carretera|Ronda|Travesía) ?(?:(?:de la|de los|de las|del|de|la|el|los|las) )?{_CAP}(?:(?: (?:de|del|la|las|los|y))* {_CAP}){{0,3}},? (?:n\.?º ?)?\d{{1,4}}[A-Za-z]?\b"
        rf"(?:, \d{{1,2}}\.?[ºª] ?\w{{1,3}}\b)?(?:, (?:\d{{5}} )?{_CAP}(?:(?: (?:de|del|la|las|los))* {_CAP}){{0,2}})?"
    ),
    re.compile(
        rf"\b(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|chaussee|steig|markt)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der) {_CAP}(?: {_CAP}){{0,2}}) \d{{1,4}} ?[a-z]?\b(?:, (?:\d{{5}} )?[A-ZÄÖÜ][\wäöüß-]+)?"
    ),
    re.compile(
        rf"\b(?:Jl\.|Jln\.?|Jalan|Gg\.|Gang|Komplek|Perumahan) {_CAP}(?: {_CAP}){{0,3}},? (?:No\.? ?)?\d{{1,4}}[A-Za-z]?\b(?:, RT ?\d+(?:/| )?(?:RW ?\d+)?)?(?:, (?:Kota|Kab\.|Kabupaten|Kec\.|Desa) {_CAP}(?: \d{{5}})?|, {_CAP}(?: \d{{5}})?)?"
    ),
    re.compile(
        r"(?:(?:(?<![一-鿿])[一-鿿]{3}|[一-鿿]{2})(?:省|自治区))?(?:(?:(?<![一-鿿])[一-鿿]{3}|[一-鿿]{2})市)?(?:[一-鿿]{2}[区县镇])?(?:[一-鿿]{2,4}(?:大道|胡同)|[一-鿿]{2,3}[路街巷弄])\d{1,5}号(?:院)?(?:\d{1,3}(?:栋|幢|号楼|座))?(?:\d{1,3}单元)?(?:\d{1,5}室)?"
    ),
    # French and Italian, Portuguese and Dutch forms
    re.compile(
        rf"\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|impasse|chemin|quai|allée|cours|route|square) (?:(?:de la|de l'|du|des|de|d') ?)?{_CAP}(?:[ -](?:(?:de|du|la|le|des) )?{_CAP}){{0,3}}(?:,? (?:\d{{5}} )?{_CAP}(?:[ -]{_CAP})?)?"
    ),
    re.compile(
        rf"\b(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada|Rua|Travessa|Praça|Alameda) (?:(?:della|delle|dei|del|di|da|do|dos|das|de) )?{_CAP}(?: (?:(?:e|di|da|do|de) )?{_CAP}){{0,3}},? (?:n\.?º? ?)?\d{{1,4}}[A-Za-z]?\b(?:, (?:\d{{5}} )?{_CAP}(?: {_CAP})?)?"
        rf"|\b[A-Z][a-z]+(?:straat|laan|plein|gracht|kade|gade|gatan|vej|vägen) \d{{1,4}}[A-Za-z]?\b(?:, (?:\d{{4}} ?[A-Z]{{2}} )?{_CAP})?"
    ),
    # A number, capitalised words, a comma and a town: an address only beside words that announce one.
    re.compile(rf"\b\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,3}}, (?:\d{{4,6}} )?{_CAP}(?: {_CAP})?(?:,? [A-Z]{{2}} \d{{4,6}})?"),
)
LOOSE = len(_ADDRESS) - 1
#: Strings of which each of the forms needs one.
_ANCHOR = tuple(
    tuple(x.split("|"))
    for x in (
        "Box | Street| St| Road| Rd| Avenue| Ave| Lane| Ln| Drive| Dr| Boulevard| Blvd| Court| Ct| Way| Place| Pl| Square| Sq| Terrace| Close| Crescent",
        "Calle|C/|Avenida|Avda|Av.|Plaza|Pza|Paseo|Pº|Camino|Carretera|Ronda|Travesía",
        "straße |strasse |str. |weg |allee |platz |gasse |ring |damm |ufer |chaussee |steig |markt |Am |An de|Im |In der |Zum |Zur |Auf de|Unter den |Hinter der ",
        "Jl. |Jln|Jalan |Gg. |Gang |Komplek |Perumahan ",
        "大道|胡同|路|街|巷|弄",
        "rue |avenue |boulevard |place |impasse |chemin |quai |allée |cours |route |square ",
        "Via |Viale |Piazza |Piazzale |Corso |Largo |Vicolo |Strada |Rua |Travessa |Praça |Alameda |straat |laan |plein |gracht |kade |gade |gatan |vej |vägen ",
        ", ",
    )
)
_DE_QUICK = re.compile(r"(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|chaussee|steig|markt) \d|\b(?:Am|An de[rn]|Im|In der|Zum|Zur|Auf de[mr]|Unter den|Hinter der) [A-ZÀ-Þ]")
_RUN = re.compile(r"[A-ZÀ-Þ][\w'’-]*\.?(?:,? [A-ZÀ-Þ][\w'’-]*\.?)+")
_WORD = re.compile(r"[\w'’-]+")
_ZH_KEY = r"(?:联系人|负责人|作者|署名|经办人|撰稿人|姓名|编辑|审核人|申请人|收件人|签名|签字|起草人|客户|医生|律师|主任|经理)(?:[：:] ?|是|为)|\"\w*(?:author|owner|name|created_by|contact|signed|person)\w*\": ?\""
_ZH_LINK = r"由|请联系|请找|联系|请教|询问|通知|拜托"
_ZH_END = r"(?=确认|撰写|起草|编写|整理|提交|负责|审核|批准|创建|新增|添加|更新|修改|昨天|今天|前天|先生|女士|老师|医生|教授|经理|律师|说|写|表示|认为)"
_ZH_NAMES = (
    re.compile(rf"(?:{_ZH_KEY})([一-鿿]{{2,4}})(?![一-鿿])"),
    re.compile(rf"(?:{_ZH_KEY}|{_ZH_LINK})({SURNAMES_ZH}[一-鿿]{{1,2}}?)(?:{_ZH_END}|(?![一-鿿]))"),
    re.compile(rf"(?<![一-鿿])({SURNAMES_ZH}[一-鿿]{{1,2}}?){_ZH_END}"),
    re.compile(rf"。({SURNAMES_ZH}[一-鿿]{{1,2}}?){_ZH_END}"),
    re.compile(rf"(?:{_ZH_KEY})({SURNAMES_ZH}[一-鿿]{{2}})"),
)
_ZH_SURNAME = re.compile(SURNAMES_ZH)

# Words that announce a type before or behind the span, and words that announce something else.
_CUE = {
    "email": (re.compile(r"(?:e-?mail|mail|owner|write to|cc|contact|send|shared ?with|surel|kirim|correo|escribe|schreib|schicke|邮箱|邮件|抄送|写信|电邮)[^\n]{0,14}$", re.I), re.compile(r"^[^\n]{0,3}(?:asked|wrote|,? (?:thanks|gracias|danke)|，?谢谢)", re.I)),
    "phone": (re.compile(r"(?:call|tel|phone|mobile|cell|fax|whatsapp|contact|\bhp\b|hubungi|telepon|llama|teléfono|móvil|telefon|handy|ruf|anrufen|手机|电话|拨打|致电)[^\n]{0,16}$", re.I), re.compile(r"^ ?(?:as the (?:mobile|phone)|anrufen|ext\.?)", re.I)),
    "id_number": (re.compile(r"(?:id number|passport|\bid\b|identity|national id|social security|tax id|licen[cs]e|nik|ktp|identitas|paspor|dni|nie|documento|pasaporte|ausweis\w*|reisepass|steuer\w*|cpf|aadhaar|iban|身份证\w*|证件\w*|护照\w*|holder_id|doc_no|ssn)[^\n]{0,10}$", re.I), re.compile(r"^ ?(?:as (?:the|an) (?:identity|id)|als ausweis|como documento|sebagai identitas)", re.I)),
    "address": (re.compile(r"(?:address|alamat|anschrift|adresse|dirección|domicilio|indirizzo|endereço|地址|住址|寄到|寄往|收件|location|ship_?to|deliver\w*|liefer\w*|lives? (?:at|in)|resid\w+|visit\w*|located|send|mail)[^\n]{0,20}$", re.I), re.compile(r"^ ?(?:schicken|senden|liefern)", re.I)),
    "person_name": (
        re.compile(r"(?:contact(?: person)?|signed|ask|author|owner(?:_name)?|created_by|\w*_?name|\bby|regards|sincerely|dear|from|met|spoke (?:to|with)|\b(?:mr|mrs|ms|dr|prof)\.?|colleague|manager|patient|customer|oleh|narahubung|tanya|hubungi|bapak|ibu|contacto|pregunta a|señora?|escribió|\bes de|de parte de|firmado|ansprechpartner(?:in)?|frag(?:en sie)?(?: bitte)?|herr|frau|von|por|atentamente|联系人|负责人|联系|由|作者|署名|姓名)[^\w\n]{0,5}$", re.I),
        re.compile(r"^(?:,? (?:wrote|said|says|added|asked|told|called|sent|signed|joined|left|works|will|yesterday|about|from|and I)\b|昨天|今天|撰写|起草|编写|确认|先生|女士|老师| (?:schrieb|sagte|hat|añadió|escribió|dijo|menulis|menambah\w*))", re.I),
    ),
}
_CONTRA = re.compile(r"(?:ticket|batch|批次|trace|rev|版本|\brun\b|运行|model|iteration|since|version|order|build|commit|sha|hash|samples|step|用例|case|size|bytes|ran on|rows?)[^\w\n]{0,4}$", re.I)
#: Endings of surnames in several languages.
_SUR_SHAPE = re.compile(r"(?:son|sen|ssen|mann|berg|stein|burg|feld|bauer|meyer|meier|müller|schmidt|ez|man|ton|ham|ford|field|wood|well|worth|ley|ski|sky|ska|ov|ova|ev|eva|enko|escu|poulos|idis|ian|yan|ini|etti|elli|ucci|quist|ström|lund|dahl|wati|anto|nova|nen)$", re.I)


_WIDE = re.compile("[\uff01-\uff5e\u3000]")
_AT_MARK = re.compile(r"[\[({<]\s?(?:at|AT|@)\s?[\])}>]|\s(?:dot|DOT)\s")


def normal(text: str) -> str:
    """Full-width letters, digits and marks as ASCII, one for one, so offsets stay."""
    return text.translate(_FULL) if not text.isascii() and _WIDE.search(text) else text


def _names(t: str):
    """(start, end, format vote, gazetteer vote) of what may be Latin full names in runs of capitalised words.

    From each run the whole without function words at its ends, its first two words, any two behind them, and
    two words as ``Surname, First``.  A word that a function word follows opens a sentence and ends no name.
    """
    for m in _RUN.finditer(t):
        words = [(w.start(), w.end(), w.group(0)) for w in _WORD.finditer(t, m.start(), m.end())]
        low = [w[2].lower() for w in words]
        shaped = [w[2][0].isupper() and (w[2][1:].islower() or w[2].isupper() or "-" in w[2] or "'" in w[2] or "’" in w[2] or w[2][:2] in ("Mc", "Ma", "De", "La", "Le", "Di")) and not any(c.isdigit() or c == "_" for c in w[2]) for w in words]
        initial = [len(w[2]) == 1 for w in words]
        gap = [t[a[1] : b[0]] for a, b in zip(words, words[1:])] + [""]
        n, k = len(words), 0
        while k < n:
            if not shaped[k] or initial[k] or low[k] in _FUNCTION or low[k] in _GREETING:
                k += 1
                continue
            # The longest stretch from here that spaces and initials hold together.
            e = k + 1
            while e < n and shaped[e] and (initial[e] and gap[e][:1] == "." or low[e] not in _FUNCTION and low[e] not in _GREETING) and (gap[e - 1] == " " or gap[e - 1] == ". " and (initial[e - 1] or low[e - 1] in _GREETING)):
                e += 1
            if e == n and e - k >= 3:
                after = re.match(r" ([^\W\d_]+)", t[words[e - 1][1] : words[e - 1][1] + 24])
                if after and after.group(1).lower() in _FUNCTION:
                    e -= 1
            full = [i for i in range(k, e) if not initial[i]]
            ends = []
            if len(full) >= 2 and not initial[e - 1]:
                ends.append(e)
            if len(full) >= 3 and full[1] + 1 not in ends:
                ends.append(full[1] + 1)
            for x in ends:
                yield words[k][0], words[x - 1][1], 1 if any(initial[k:x]) else -1, _name_vote(low[k:x])
            for a, b in zip(full[2:], full[3:]):
                yield words[a][0], words[b][1], 1 if b > a + 1 else -1, _name_vote([low[a], low[b]])
            if e - k == 1 and e < n and gap[k] == ", " and shaped[e] and not initial[e] and low[e] not in _FUNCTION and low[e] not in _GREETING:
                yield words[k][0], words[e][1], -1, _name_vote([low[e], low[k]])
            k = e


def _name_vote(words: list[str]) -> int:
    """1 for a common first name before or a surname's ending behind, 0 for words of places and for two names in a row."""
    if any(w in _PLACE for w in words) or len(words) >= 4 and any(w in FIRST_NAMES for w in words[2:-1]):
        return 0
    return 1 if words[0] in FIRST_NAMES or any(_SUR_SHAPE.search(w.split("-")[-1]) and len(w) > 4 for w in words[1:]) else -1


def _is_iban(v: str) -> bool:
    v = v.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def propose(text: str, normalised: str | None = None) -> list[tuple[str, int, int, int, int]]:
    """Candidates (kind, start, end, format vote, gazetteer vote); votes are 1, 0 or -1 for none.

    Candidates may overlap; only names inside emails and ids are left out at once.
    """
    t = normal(text) if normalised is None else normalised
    out: list[tuple[str, int, int, int, int]] = []
    if "@" in t or _AT_MARK.search(t):
        for m in _EMAIL.finditer(t):
            out.append(("email", m.start(), m.end(), 1 if _EMAIL_STRICT.match(m.group(0)) else -1, 1 if re.search("[A-Za-z]+$", m.group(0)).group(0).lower() in ("com", "org", "net", "test", "example", "invalid", "edu", "de", "es", "id", "cn") else -1))
    firm = [(c[1], c[2]) for c in out]
    for m in _IBAN.finditer(t):
        if _is_iban(m.group(0)):
            out.append(("id_number", m.start(), m.end(), 1, 1))
            firm.append((m.start(), m.end()))
    for m in _NUMBER.finditer(t):
        s, e, v = m.start(), m.end(), m.group(0)
        if v[0] == "(" and ")" not in v:
            s, v = s + 1, v[1:]
        digits = sum(c.isdigit() for c in v)
        if digits < 7:
            continue
        if _ID_STRICT.fullmatch(v):
            out.append(("id_number", s, e, 1, -1))
        elif re.fullmatch(r"\d{4}[ -]\d{4}[ -]\d{4}", v):
            out.append(("id_number", s, e, -1, -1))
        elif _PHONE_STRICT.fullmatch(v) and not _NOT_NUMBER.fullmatch(v):
            out.append(("phone", s, e, 1, 1 if v[0] in "+(" else -1))
        else:
            f = 0 if _NOT_NUMBER.fullmatch(v) or digits > 15 or v[-1].isalpha() else -1
            out.append(("phone" if digits <= 13 else "id_number", s, e, f, -1))
    docs = set()
    for m in _DOCNO.finditer(t):
        v = m.group(0)
        if not v.isdigit() and sum(c.isdigit() for c in v) >= 3:
            docs.add(m.start())
            out.append(("id_number", m.start(), m.end(), 1, -1))
    cue = _CUE["id_number"][0]
    for m in _CODE.finditer(t):
        # Any code of letters and digits that is announced as an identity number.
        if m.start() not in docs and not m.group(0).isdigit() and cue.search(t[max(0, m.start() - 40) : m.start()]):
            out.append(("id_number", m.start(), m.end(), -1, -1))
    left_of = _CUE["address"][0]
    for k, (anchor, r) in enumerate(zip(_ANCHOR, _ADDRESS)):
        if any(x in t for x in anchor) and (k != 2 or _DE_QUICK.search(t)):
            for m in r.finditer(t):
                if k != LOOSE:
                    out.append(("address", m.start(), m.end(), 1, 1 if "," in m.group(0) or k == 4 and re.search("[省市区县]", m.group(0)) else -1))
                elif left_of.search(t[max(0, m.start() - 40) : m.start()]) and not any(c[0] == "address" and c[1] < m.end() and m.start() < c[2] for c in out):
                    out.append(("address", m.start(), m.end(), -1, 1))
    # Names are looked for beside emails, account numbers and addresses of a known form.
    rest = t
    for a, b in firm + [(c[1], c[2]) for c in out if c[0] == "address" and c[3] == 1]:
        rest = f"{rest[:a]}{'0' * (b - a)}{rest[b:]}"
    out += [("person_name", *c) for c in _names(rest)]
    if not t.isascii():
        seen = set()
        for k, r in enumerate(_ZH_NAMES):
            for m in r.finditer(t):
                s, e = m.span(1)
                if s not in seen:
                    seen.add(s)
                    out.append(("person_name", s, e, 1 if k in (0, 1) else -1, 1 if _ZH_SURNAME.match(t, s) else -1))
    return out


def _shape(v: str) -> str:
    v = re.sub(r"[0-9]", "9", v)
    v = re.sub(r"[a-zà-ÿ]+", "a", v)
    v = re.sub(r"[A-ZÀ-Þ]{2,}", "AA", v)
    return re.sub(r"[一-鿿]+", "汉", v)[:24]


def _h(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % DIM


def describe(t: str, c: tuple[str, int, int, int, int]) -> tuple[int, list[int]]:
    """(vote pattern in base 3, feature hashes) of a candidate in a normalised text."""
    kind, s, e, fmt, gaz = c
    left, right = t[max(0, s - 40) : s], t[e : e + 24]
    cue_left, cue_right = _CUE[kind]
    contra = 0 if _CONTRA.search(left) else -1
    context = 1 if cue_left.search(left) or cue_right.search(right) else -1
    votes = (fmt, gaz, context, contra)
    pattern = 0
    for v in votes:
        pattern = pattern * 3 + (v + 1)
    lw = re.findall(r"[^\W\d_]+", left[-24:])
    rw = re.match(r"\W{0,3}([^\W\d_]+)", right)
    if kind == "person_name":
        # The words themselves: what the corpus often has beside no name's context is learned to be none.
        words = re.findall(r"[^\W\d_]+", t[s:e].lower()) or [""]
        names = [_h(kind, "first", words[0]), _h(kind, "last", words[-1]), _h(kind, "end", words[-1][-3:]), _h(kind, "words", min(5, len(words))), _h(kind, "mark", t[e : e + 1], t[s - 1 : s])]
    else:
        names = []
    feats = [_h(kind, "bias")] + [_h(kind, n, v) for n, v in zip(LABELERS, votes)]
    feats += [_h(kind, "shape", _shape(t[s:e])), _h(kind, "left", lw[-1].lower()[-12:] if lw else ""), _h(kind, "right", rw.group(1).lower()[:4] if rw else right[:1])]
    return pattern, feats + names


_SPAN = pa.struct([("kind", pa.int8()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("pattern", pa.int32()), ("feats", pa.list_(pa.int32()))])
_CAND = pa.schema([("row_id", pa.int64()), ("spans", pa.list_(_SPAN))])
_CAND_DDL = "row_id long, spans array<struct<kind: tinyint, start_pos: bigint, end_pos: bigint, pattern: int, feats: array<int>>>"


def _candidates(batches):
    for b in batches:
        ids, spans = [], []
        for rid, text in zip(b.column("row_id").to_pylist(), b.column("text").to_pylist()):
            t = normal(text or "")
            found_ = propose(text, t) if text else None
            if not found_:
                continue
            rows = []
            for c in found_:
                pattern, feats = describe(t, c)
                rows.append({"kind": KINDS.index(c[0]), "start_pos": c[1], "end_pos": c[2], "pattern": pattern, "feats": feats})
            ids.append(rid)
            spans.append(rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(_SPAN))], schema=_CAND)


def vote_model(counts: list[tuple[int, int, int]], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Expectation-maximisation over (kind, vote pattern, count): pattern -> probability of being real.

    Labelers are taken as independent given the truth; abstaining is a vote like any other, and
    each kind has its own reliabilities.  It starts from the balance of the votes.
    """
    out: dict[tuple[int, int], float] = {}
    L = len(LABELERS)
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(p, n) for k, p, n in counts if k == kind]
        votes = np.array([[(p // 3 ** (L - 1 - j)) % 3 for j in range(L)] for p, _ in rows])
        n = np.array([x for _, x in rows], float)
        balance = (votes == 2).sum(1) - 2.0 * (votes == 1).sum(1)
        post = 1 / (1 + np.exp(-2.0 * (balance - 0.5)))
        for _ in range(rounds):
            w1, w0 = n * post, n * (1 - post)
            prior = (w1.sum() + 1) / (n.sum() + 2)
            logit = np.full(len(rows), np.log(prior / (1 - prior)))
            for j in range(L):
                silent, yes, no = votes[:, j] == 0, votes[:, j] == 2, votes[:, j] == 1
                # How often it is silent is drawn to its rate over all, so that one that never speaks says nothing.
                rate = n[silent].sum() / n.sum()
                s1, s0 = [(w[silent].sum() + 10 * rate + 1e-9) / (w.sum() + 10 + 2e-9) for w in (w1, w0)]
                # Pseudo-counts hold what it says better than chance: a yes speaks for, a no against.
                y1 = (w1[yes].sum() + 8) / (w1[yes].sum() + w1[no].sum() + 9)
                y0 = (w0[yes].sum() + 1) / (w0[yes].sum() + w0[no].sum() + 9)
                logit[silent] += np.log(s1 / s0)
                logit[yes] += np.log((1 - s1) * y1 / ((1 - s0) * y0))
                logit[no] += np.log((1 - s1) * (1 - y1) / ((1 - s0) * (1 - y0)))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - post).max() < 1e-6:
                post = new
                break
            post = new
        out.update({(kind, p): float(x) for (p, _), x in zip(rows, post)})
    return out


def train_classifier(feats: list[list[int]], soft: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic regression on hashed features with soft labels (gradient steps scaled per feature)."""
    w = np.zeros(DIM)
    if not feats:
        return w
    width = max(map(len, feats))
    x = np.array([f + [f[0]] * (width - len(f)) for f in feats])
    g2 = np.full(DIM, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(p - soft, width), DIM) / len(feats) + 1e-5 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def candidates(texts: DataFrame) -> DataFrame:
    """Candidates of a table of (row_id, text)."""
    ship(texts.sparkSession)
    return texts.where("row_id is not null and text is not null").select(F.col("row_id").cast("long").alias("row_id"), "text").mapInArrow(_candidates, _CAND_DDL)


def fit(cands: DataFrame) -> np.ndarray:
    """Weights of the span classifier; what comes to the driver is bounded (patterns, TRAIN_SPANS rows)."""
    c = cands.select("row_id", F.explode("spans").alias("c")).select("row_id", "c.*")
    counts = [(r.kind, r.pattern, r.n) for r in c.groupBy("kind", "pattern").agg(F.count("*").alias("n")).collect()]
    post = vote_model(counts)
    total = max(1, sum(n for _, _, n in counts))
    share = min(1.0, 0.9 * TRAIN_SPANS / total)
    sample = c.where(F.pmod(F.xxhash64("row_id", "start_pos"), F.lit(1_000_000)) < int(share * 1_000_000)).select("kind", "pattern", "feats").limit(TRAIN_SPANS).collect()
    return train_classifier([list(r.feats) for r in sample], np.array([post[r.kind, r.pattern] for r in sample]))


_LOGIT = float(np.log(THRESHOLD / (1 - THRESHOLD)))


def resolve(scored: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of (score, kind, start, end) those that pass, without overlaps: emails and the most probable first, then earlier and longer."""
    kept: list[tuple[float, int, int, int]] = []
    for c in sorted((c for c in scored if c[0] >= _LOGIT), key=lambda c: (c[1] != 0, -c[0], c[2], c[2] - c[3])):
        if all(c[3] <= k[2] or c[2] >= k[3] for k in kept):
            kept.append(c)
    return kept


def _decider(weights: np.ndarray):
    def decide_(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for tbl, rid, spans in zip(*[b.column(c).to_pylist() for c in ("tbl", "row_id", "spans")]):
                for _, kind, s, e in resolve([(float(weights[c["feats"]].sum()), c["kind"], c["start_pos"], c["end_pos"]) for c in spans]):
                    for col, v in zip(cols, (tbl, rid, KINDS[kind], s, e)):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=["tbl", "row_id", "pii_type", "start_pos", "end_pos"])

    return decide_


def decide(cands: DataFrame, weights: np.ndarray) -> DataFrame:
    """Candidates whose score passes: (tbl, row_id, pii_type, start_pos, end_pos)."""
    return cands.select("tbl", "row_id", "spans").mapInArrow(_decider(weights), "tbl string, row_id long, pii_type string, start_pos long, end_pos long")


def _sources(chats: DataFrame, events: DataFrame):
    return chats.select(F.lit("chat_messages").alias("tbl"), F.col("message_id").alias("row_id"), F.col("content").alias("text")), events.select(
        F.lit("tool_events").alias("tbl"), F.col("event_id").alias("row_id"), F.col("response").alias("text")
    )


def all_candidates(chats: DataFrame, events: DataFrame) -> DataFrame:
    parts = [candidates(s).withColumn("tbl", F.lit(n)) for s, n in zip(_sources(chats, events), ("chat_messages", "tool_events"))]
    return materialize(parts[0].unionByName(parts[1]), "spans")


def found(chats: DataFrame, events: DataFrame) -> DataFrame:
    """(tbl, row_id, pii_type, start_pos) of every mention."""
    c = all_candidates(chats, events)
    return decide(c, fit(c)).select("tbl", "row_id", "pii_type", "start_pos").distinct()


def _redactor(weights: np.ndarray):
    def redact_(batches):
        for b in batches:
            texts, n = [], []
            for text in b.column("text").to_pylist():
                spans = []
                if text:
                    t = normal(text)
                    spans = resolve([(float(weights[describe(t, c)[1]].sum()), KINDS.index(c[0]), c[1], c[2]) for c in propose(text, t)])
                for _, kind, s, e in sorted(spans, key=lambda c: -c[2]):
                    text = f"{text[:s]}[{KINDS[kind].upper()}]{text[e:]}"
                texts.append(text)
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("row_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["tbl", "row_id", "redacted", "n_mentions"])

    return redact_


def redacted(chats: DataFrame, events: DataFrame) -> DataFrame:
    """Every text with mentions, placeholders in their place and the rest unchanged."""
    w = fit(all_candidates(chats, events))
    a, b = _sources(chats, events)
    both = a.unionByName(b).where("row_id is not null and text is not null").select("tbl", F.col("row_id").cast("long").alias("row_id"), "text")
    out = both.mapInArrow(_redactor(w), "tbl string, row_id long, redacted string, n_mentions int").where("n_mentions > 0")
    return out.dropDuplicates(["tbl", "row_id"])
