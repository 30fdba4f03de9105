"""Fixed values.

These literals must equal the ones the recorded model outputs, judge replies
and chat renderings use, otherwise parsing gives different results.  They are
kept together here, as plain text, in the order they appear in a response.
"""

# --- fixed values: response markers -------------------------------------
SELF_REFLECTION = "Self-reflection: "      # main parse, with trailing space
CONFIDENCE = "Confidence: "                # main parse, with trailing space
SELF_REFLECTION_BARE = "Self-reflection:"  # sampled-text split
CONFIDENCE_BARE = "Confidence:"            # validity test, sampled-text split
HEDGE = "I am"                             # legacy parse, hedge truncation
UNSURE = "unsure"                          # sure/unsure parse
SURE_PHRASE = "I am sure"                  # r-tuning validity
UNSURE_PHRASE = "I am unsure"              # r-tuning validity
FOLLOW_UP = ("Are you sure you accurately answered the question based on "
             "your internal knowledge")    # cut from sampled reflections
NOT_AVAILABLE = "N/A"                      # missing reflection
PAD = "<pad>"                              # removed from decoded text
INST_OPEN = "[INST]"                       # instruction tags
INST_CLOSE = "[/INST]"
SCORE_MARKER = "score:"                    # rating replies (case-insensitive)
REASON_MARKER = "Reason:"                  # summary replies
IGNORE_INDEX = -100                        # masked label value
# --- end of fixed values ---------------------------------------------------

# Characters Python's str.strip() removes, derived from str.isspace (all of
# them lie below U+3001).
PY_WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The same set as one regex class understood by both Java regex and RE2.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
