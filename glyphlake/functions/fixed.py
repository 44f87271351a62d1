"""Fixed values that results depend on: word lists, ranges, limits and tables."""

# Character classes.
HIRAGANA_LETTERS = "\\u3041-\\u309F"
KATAKANA_LETTERS = "\\u30A1-\\u30FA\\u30FC"
KANA_BLOCKS = "\\u3040-\\u30FF"
KANJI = "\\u4E00-\\u9FFF"
CJK = "\\u3000-\\u303F\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FFF\\uFF00-\\uFFEF"
JAPANESE_TEXT = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF々〆ヶ"
SMALL_KANA = "ゃゅょぁぃぅぇぉャュョァィゥェォヮ"

# Characters that compatibility folding never changes and that
# never combine with a neighbour.
NFKC_STABLE = ("\\u0000-\\u007F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E"
               "\\u3001-\\u3035\\u3041-\\u3096\\u30A1-\\u30FC\\u4E00-\\u9FFF")

# Longest match in glyphs, entries per dictionary on the first
# screen, accents and frequencies shown, senses kept.
MAX_MATCH = 12
FIRST_SCREEN_PER_DICT = 2
SHOWN_PITCH = 4
SHOWN_FREQ = 2
MAX_SENSES = 8
MAX_NAME_READINGS = 24
MAX_MEANINGS = 5

# Sentence ends and the characters that continue one.
SENTENCE_END = "。！？"
SENTENCE_CONTINUE = "」』）。！？…"

# Passage length targets and the shortest tail kept.
PASSAGE_TARGETS = (60, 90, 120, 160, 200)
PASSAGE_MIN_TAIL = 40

# Fragments that stand beside real senses and are dropped.
TAG_NOISE = (
    "noun", "verb", "adverb", "adjective", "na-adj", "i-adj", "no-adj",
    "pronoun", "particle", "conjunction", "interjection", "prefix", "suffix",
    "counter", "expression", "suru", "transitive", "intransitive", "ichidan",
    "godan", "usually kana", "abbreviation", "colloquial", "archaic",
    "honorific", "humble", "polite", "slang", "obsolete", "rare", "vulgar",
    "christian", "buddhism", "shinto", "medicine", "physics", "chemistry",
    "biology", "mathematics", "computing", "military", "legal", "grammar",
    "jmdict", "jmnedict", "jitendex", "tatoeba", "see also", "|", "｜",
    "forms", "name", "given name", "surname", "place", "company", "product",
)

# Marks of link lines, headword lines and part-of-speech lines.
URL_MARKS = ("google.com/", "neocities.org", "http://", "https://")
HEADWORD_MARKS = ("【", "読み方：")

# Subtrees that hold no definition text.
JM_SKIP = ("extra-info", "attribution", "forms", "part-of-speech-info")
MONO_SKIP = ("見出部", "用例G", "アクセント", "品詞G", "歴史的仮名遣い", "補説G")

# Node names and the role each one plays.
ROLES = {
    "sense": "sense", "glossary": "glossary", "sense-group": "sense-group",
    "example-sentence": "example", "example-sentence-a": "example-ja",
    "example-sentence-b": "example-en", "example-keyword": "keyword",
    "part-of-speech-info": "tag", "misc-info": "tag", "tag": "tag",
    "sense-note-label": "note-label", "sense-note-content": "note",
    "xref": "xref", "reference-label": "xref-label",
    "xref-content": "xref", "xref-glossary": "xref",
    "attribution": "meta", "forms": "meta", "forms-label": "meta",
    "attribution-footnote": "meta", "graphic-attribution": "meta",
    "extra-info": "extra", "extra-box": "extra",
    "語釈": "sense", "語義": "sense-group", "語義番号": "sense-num",
    "大語義": "division", "用例": "example", "用例G": "example",
    "品詞": "tag", "品詞G": "tag", "品詞subG": "tag", "語構成": "tag",
    "表記": "note", "表記G": "note", "注記": "note", "補説G": "note",
    "参照": "xref", "参照G": "xref", "参照矢印": "xref", "対義語G": "xref",
    "アクセント": "meta", "平板": "meta", "分書": "wordsep",
    "ルビG": "furigana", "ルビ": "furigana",
    "見出部": "headword", "見出仮名": "headword", "見出相当部": "headword",
    "最重要語": "core", "homophone": "homophone", "furigana": "furigana",
}
ROLES_BY_SOURCE = (("最重要語", "core"), ("重要語", "core"), ("筆順", "meta"),
                   ("アクセント", "meta"), ("stroke", "meta"))

# Style properties that are kept.
STYLES = ("verticalAlign", "marginRight", "marginLeft", "fontSize", "fontWeight",
          "listStyleType", "fontStyle", "textDecorationLine")

# Dictionary label prefixes, their kinds, and the kind order.
DICT_KINDS = (
    ("Jitendex", "bi"), ("JMdict", "bi"), ("Names", "name"), ("JMnedict", "name"),
    ("KANJIDIC", "kanji"),
    ("三省堂", "mono"), ("明鏡", "mono"), ("旺文社", "mono"), ("実用", "mono"),
    ("DOJG", "gram"), ("どんなとき", "gram"), ("日本語文法辞典", "gram"),
)
KIND_ORDER = ("bi", "mono", "gram", "kanji", "name")

# Known archives in priority order, with their labels.
KNOWN_ARCHIVES = (
    ("jitendex-yomitan.zip", "Jitendex"), ("mono-sankoku8.zip", "三省堂"),
    ("mono-meikyo2.zip", "明鏡"), ("mono-oukoku11.zip", "旺文社"),
    ("mono-jitsuyou.zip", "実用"), ("gram-dojg.zip", "DOJG"),
    ("gram-donna.zip", "どんなとき"), ("kty-ja-ja.zip", "Wiktionary"),
    ("JMnedict.zip", "Names"), ("KANJIDIC_english.zip", "KANJIDIC"),
)

# Image types by file extension.
IMAGE_TYPES = {
    "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "avif": "image/avif", "bmp": "image/bmp",
}
OTHER_TYPE = "application/octet-stream"
