"""Fixed values the results depend on.

These are stated once, in natural order, as plain data. Everything else in
the library derives from them or from the input tables.
"""

# --- fixed values: generic possessive slots of LU names -> POS wildcards ---
GENERICS = {
    "one's": ["<PRON>", "<PROPN>"],
    "someone's": ["<PRON>", "<PROPN>"],
}

# --- fixed values: surface aliases (token text -> lexicon word) ---
ALIASES = [
    ("mm", "millimeter"),
    ("cm", "centimeter"),
    ("instal", "install"),
    ("could", "can"),
    ("couldn't", "can't"),
]

# --- fixed values: ambiguity overrides (lemma, POS) -> (LU words, extra chars) ---
OVERRIDES = [
    ("kind", "NOUN", "kind", 0),
    ("kind", "ADV", "kind of", 3),
]

# --- fixed values: LUs added to every lexicon (name, frame) ---
EXTRA_SIMPLE = [
    ("but", "Concessive"),
    ("however", "Concessive"),
    ("around", "Locative_relation"),
    ("grand", "Dimension"),
    ("maintain", "Activity_ongoing"),
    ("proceed", "Activity_ongoing"),
    ("start", "Setting_fire"),
]
EXTRA_NAMED = [
    ("' ve got on.MANUAL", "Wearing"),
    ("' ve got.MANUAL", "Possession"),
    ("' ve got.MANUAL", "Have_associated"),
    ("' ve on.MANUAL", "Wearing"),
    ("' ve over.MANUAL", "Have_visitor_over"),
    ("' ve to do (with).MANUAL", "Cognitive_connection"),
    ("' ve to.MANUAL", "Required_event"),
    ("' ve to.MANUAL", "Desirable_event"),
    ("let (one's) know.MANUAL", "Telling"),
]

# --- fixed values: spelling suffix rules (American ending, British ending) ---
# Default variant pairs come from these ending rules over the lexicon's own
# words; a list of pairs can be passed instead.
SPELLING_SUFFIXES = [
    ("or", "our"),
    ("ors", "ours"),
    ("ored", "oured"),
    ("oring", "ouring"),
    ("ize", "ise"),
    ("izes", "ises"),
    ("ized", "ised"),
    ("izing", "ising"),
    ("izer", "iser"),
    ("yze", "yse"),
    ("ization", "isation"),
    ("er", "re"),
    ("ers", "res"),
    ("og", "ogue"),
    ("ense", "ence"),
    ("eler", "eller"),
    ("eled", "elled"),
    ("eling", "elling"),
]
# letters before the ending (so that "for" and "four" are no pair)
SPELLING_MIN_STEM = 2

# --- fixed values: number words for the NUM rule ---
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight",
        "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
        "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy",
        "eighty", "ninety"]
SCALES = ["", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion",
          " sextillion", " septillion", " octillion", " nonillion", " decillion"]

# --- fixed values: the default annotator's form lexicon (form -> lemma, POS) ---
FORMS = [
    ("has", "have", "VERB"),
    ("is", "be", "AUX"),
    ("was", "be", "AUX"),
    ("are", "be", "AUX"),
    ("it", "it", "PRON"),
    ("his", "his", "PRON"),
    ("her", "her", "PRON"),
    ("they", "they", "PRON"),
    ("this", "this", "PRON"),
    ("that", "that", "PRON"),
    ("him", "him", "PRON"),
]

# --- fixed values: the inline lexicon fixture (LU name, frame) ---
FIXTURE_LUS = [
    ("the.art", "Definiteness"),
    ("of.prep", "Partitive"),
    ("of.prep", "Origin"),
    ("of the.prep", "Partitive"),
    ("is the.v", "Identity"),
    ("to the.prep", "Goal"),
    ("the the the.idio", "Repetition"),
    ("the and attion.idio", "Listing"),
    ("and.c", "Conjoined"),
    ("be.v", "Existence"),
    ("on-the.prep", "Spatial_contact"),
    ("th [N and S].n", "Place"),
    ("is (the/a).v", "Identity"),
    ("of (one's).prep", "Possession"),
    ("That.pron", "Reference"),
    ("one.num", "Cardinal"),
    ("color.n", "Color"),
    ("brother-in-law.n", "Kinship"),
    ("pull (someone's) leg.v", "Joking"),
    ("(in/out) of line.a", "Conformity"),
    ("American [N and S Am].a", "Origin"),
    ("kind.n", "Type"),
    ("kind of.adv", "Degree"),
    ("have.v", "Possession"),
    ("have to.v", "Required_event"),
    ("have to do (with).v", "Cognitive_connection"),
    ("give up.v", "Surrender"),
    ("can.v", "Capability"),
    ("let him be.v", "Allowing"),
    ("let (one's) know.v", "Telling"),
]

# --- fixed values: part-derived lexicon, POS by p_partkey % 5 ---
PART_POS = ["n", "v", "a", "adv", "prep"]

# --- fixed values: choice-list separator and label of the target layer ---
CHOICE_SEP = "~$~"
CHOICE_SEP_REGEX = "~\\$~"

# --- fixed values: held-out sources standing in for the dev/test file lists ---
DEV_SOURCES = ["src1", "src7"]
TEST_SOURCES = ["src3", "src5", "src11"]
