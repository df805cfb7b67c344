"""Fixed values that must equal the reference's for identical results.

Everything in this module is data, stated as text in its natural order:
separators of the tuple format, prompt wording, worked few-shot examples, the
annotation request header, special ids and numeric limits.
"""

# --- fixed values: tuple text format -------------------------------------
PART_SEP = " ,, "          # between subject, predicate and objects
PART_SPLIT = ",,"          # what the parser splits on
INNER_SEP = " ### "        # auxiliary ### predicate, preposition ### object
INNER_SPLIT = "###"
PRED_FIRST_SEP = " ;; "    # annotation format, predicate first
GENERATION_SUFFIX = "1. "  # appended after the rendered chat prompt

# --- fixed values: prompt wording ------------------------------------------
SYSTEM_INSTRUCTION = (
    "You are an Open IE system to extract open relation triples from text. "
    "Include diverse subjects, avoid repetition. Format: \n"
    "<subject> ,, <auxilliary ### predicate> ,, <prep1 ### object1> ,, "
    "<prep2 ### object2> ,, ... ."
)
USER_PREFIX = "Extract a list of open relation triples from the following sentence: "

# --- fixed values: worked examples used as few-shot turns ("train" set) ---
FEW_SHOT_TRAIN = [
    (
        "Earlier this year, President Bush made a final `` take - it - or - leave it '' offer on the minimum wage : an increase to $ 4.25 an hour over three years, and only if accompanied by a lower wage for the first six months of a job.",
        "1. President Bush ,,  made ,, a final `` take - it - or - leave it '' offer ,, on ### the minimum wage ,, earlier ### this year\n"
        "2. Bush ,,  is ,, President\n"
        "3. President Bush's final `` take - it - or - leave it '' offer on the minimum wage ,,  was an increase ,, to ### $ 4.25 an hour ,, over ### three years\n"
        "4. President Bush's final `` take - it - or - leave it '' offer on the minimum wage ,,  was an increase ,, only if ### accompanied by a lower wage for the first six months of a job\n"
        "5. a lower wage ,,  will be ,, for ### a job ,, in ### the first six months",
    ),
    (
        "This finding indicated that organic compounds could carry current.",
        "1. This finding ,,  indicated ,, that ### organic compounds could carry current\n"
        "2. organic compounds ,,  could carry ,, current",
    ),
    (
        "However, Jesus is not accepted as the son by Muslims, who strictly maintain that he was a human being who was loved by God and exalted by God to ranks of the most righteous.",
        "1. Jesus ,,  not ### is accepted ,, by ### Muslims ,, as ### the son\n"
        "2. Muslims ,,  strictly maintain that Jesus was ,, a human being\n"
        "3. Muslims ,,  strictly maintain that Jesus was loved ,, by ### God\n"
        "4. Muslims ,,  strictly maintain that Jesus was exalted ,, to ### ranks of the most righteous ,, by ### God\n"
        "5. Jesus ,,  was ,, a human being\n"
        "6. God ,,  loved ,, Jesus\n"
        "7. God ,,  exalted ,, Jesus ,, to ### ranks of the most righteous",
    ),
    (
        "After a short absence Keibler began a short feud with the evil Jillian Hall, which led to the two having a match on `` Velocity '', which Keibler lost.",
        "1. Keibler ,,  began ,, a short feud ,, with ### the evil Jillian Hall ,, after ### a short absence\n"
        "2. a short feud with the evil Jillian Hall ,,  led to ,, the two having a match ,, on ### \"Velocity\"\n"
        "3. Keibler ,,  lost ,, a match ,, on ### \"Velocity\"",
    ),
]

# --- fixed values: worked examples for large-scale prediction ("test" set) --
FEW_SHOT_TEST = [
    (
        "Burnham died of heart failure at the age of 86, on September 1, 1947 at his home in Santa, Barbara, California.",
        "1. Burnham ,,  died ,, of ### heart failure ,, at ### the age of 86 ,, on ### September 1 , 1947 ,, at ### his home in Santa Barbara , California\n"
        "2. Burnham ,,  had ,, his home ,, in ### Santa Barbara , California\n"
        "3. Santa Barbara ,,  is ,, in ### California",
    ),
    (
        "Godzilla and Battra battled on the ocean floor, until they caused a rift to open between tectonic plates.",
        "1. Godzilla ,,  battled ,, Battra ,, on ### the ocean floor\n"
        "2. Battra ,,  battled ,, Godzilla ,, on ### the ocean floor\n"
        "3. Godzilla and Battra ,,  caused ,, a rift to open ,, between ### tectonic plates\n"
        "4. Godzilla and Battra ,,  battled ,, on ### the ocean floor ,, until ### they caused a rift to open",
    ),
    (
        "And he was in Ali's army in the Battle of Jamal and later it was Muhammad ibn Abu Bakr who escorted Aisha back to Madina.",
        "1. he ,,  was ,, in ### Ali 's army\n"
        "2. he ,,  was ,, in ### the Battle of Jamal\n"
        "3. Ali 's army ,,  was ,, in ### the Battle of Jamal\n"
        "4. Muhammad ibn Abu Bakr ,,  escorted ,, Aisha ,, back ### to Madina ,, later\n"
        "5. he ,,  was ,, Muhammad ibn Abu Bakr",
    ),
    (
        "Byers states that global citizenship is a `` powerful term '' because `` people that invoke it do so to provoke and justify action, '' and encourages the attendees of his lecture to re-appropriate it in order for its meaning to have a positive purpose, based on idealistic values.",
        "1. Byers ,,  states ,, that ### global citizenship is a \"powerful term\" because \"people that invoke it do so to provoke and justify action\"\n"
        "2. Byers ,,  encourages ,, the attendees of his lecture ,, to ### re-appropriate it in order for its meaning to have a positive purpose ,, based on ### idealistic values\n"
        "3. global citizenship ,,  is ,, a \"powerful term\"\n"
        "4. people ,,  invoke ,, it ,, to ### provoke and justify action\n"
        "5. attendees of his lecture ,,  re-appropriate ,, it ,, in order for its meaning to have a positive purpose ,, based on ### idealistic values",
    ),
]

# --- fixed values: annotation request header (instructions + 3 worked cases)
_ANNOTATION_RULES = (
    "convert open IE annotation to the appropriate format:\n"
    "a. annotate prepositions for each object when applicable;\n"
    "b. do not cut away prepositional modifiers from arguments, only cut away prepositional modifiers from predicates;\n"
    "c. extract embedded triples in ``said'' / ``claimed'' structures;\n"
    "d. move modals and negations to \"auxilliary\";\n"
    "e. keep the original order of elements;\n\n"
)
ANNOTATION_HEADER = (
    _ANNOTATION_RULES
    + "Sentence: Tom Bradley joined the London , Midland and Scottish Railway Company as a junior clerk in the Goods Depot at Kettering in 1941 .\n\n"
    "Before: \n"
    "1. joined ;; Tom Bradley ;; the London, Midland and Scottish Railway Company ;; as a junior clerk in the Goods Depot ;; at Kettering ;; in 1941\n"
    "2. exists ;; a Goods Depot ;; in Ketering ;; in 1941\n"
    "3. exists ;; the London, Midland and Scottish Railway Company ;; at Kettering ;; in 1941\n"
    "4. is ;; Tom Bradley ;; a junior clerk in the Goods Depot ;; at Kettering ;; in 1941\n\n"
    "After: \n"
    "1. joined ;;Tom Bradley ;; the London, Midland and Scottish Railway Company ;; as ### a junior clerk in the Goods Depot at Kettering ;; in ### 1941\n"
    "2. exists ;; a Goods Depot ;; in ### Kettering ;; in ### 1941\n"
    "3. exists ;; the London, Midland and Scottish Railway Company ;; in ### Kettering ;; in ### 1941\n"
    "4. is ;; Tom Bradley ;; a junior clerk ;; in ### the Goods Depot ;; at ### Kettering ;; in ### 1941\n\n"
    + _ANNOTATION_RULES
    + "Sentence: However , Jesus is not accepted as the son by Muslims , who strictly maintain that he was a human being who was loved by God and exalted by God to ranks of the most righteous .\n\n"
    "Before: \n"
    "1. is not accepted as ;; Jesus ;; the son\n"
    "2. strictly maintain that Jesus was  ;; Muslims ;; a human being\n"
    "3. strictly maintain that Jesus was loved by ;; Muslims ;; God\n"
    "4. strictly maintain that Jesus was exalted to ranks of the most rightuous by ;; Muslims ;; God\n\n"
    "After: \n"
    "1. not ### is accepted ;; Jesus ;; by ### Muslims ;; as ### the son\n"
    "2. strictly maintain that Jesus was ;; Muslims ;; a human being\n"
    "3. strictly maintain that Jesus was loved ;; Muslims ;; by ### God\n"
    "4. strictly maintain that Jesus was exalted ;; Muslims ;; to ### ranks of the most rightuous ;; by ### God\n"
    "5. was ;; Jesus ;; a human being\n"
    "6. loved ;; God ;; Jesus\n"
    "7. exalted ;; God ;; Jesus ;; to ### ranks of the most rightuous\n\n"
    + _ANNOTATION_RULES
    + "Sentence: From 1970 to 1985 , Gideon Rodan taught at the University of Connecticut School of Dental Medicine until he switched over to Merck .\n\n"
    "Before: \n"
    "1. taught at ;; Gideon Rodan ;; the University of Connecticut School of Dental Medicine ;; from 1970\n"
    "2. taught at ;; Gideon Rodan ;; the University of Connecticut School of Dental Medicine ;; to 1985\n"
    "3. taught at ;; Gideon Rodan ;; the University of Connecticut School of Dental Medicine ;; until he switched over to Merck\n"
    "4. switched over to ;; He ;; Merck\n"
    "5. has ;; the University of Connecticut ;; a School of Dental Medicine\n\n"
    "After: \n"
    "1. taught ;; Gideon Rodan ;; at ### the University of Connecticut School of Dental Medicine ;; from ### 1970 ;; to ### 1985 ;; until ### he switched over to Merck\n"
    "2. switched over ;; Gideon Rodan ;; to ### Merck\n"
    "3. has ;; the University of Connecticut ;; a School of Dental Medicine\n\n"
    + _ANNOTATION_RULES
    + "Sentence: "
)

# --- fixed values: ids and limits ------------------------------------------
IGNORE_INDEX = -100            # label value the loss skips
BOS_ID, EOS_ID, PAD_ID, UNK_ID = 0, 1, 2, 3   # our vocabulary's reserved ids
SPECIAL_TOKENS = ["<s>", "</s>", "<pad>", "<unk>"]
DEFAULT_MAX_LENGTH = 2048      # prompt length limit, tokens
DEFAULT_MAX_NEW_TOKENS = 256   # new tokens per sentence
LONG_OUTPUT_TOKENS = 510       # outputs above this are reported
DISTANCE_FALLBACK = 20         # distance per match for over-effort sentences
CHUNK_SIZE = 10000             # documents per corpus chunk
MIN_REPLY_CHARS = 10           # shorter annotation replies are retried/rejected
MIN_ANNOTATION_LINE = 5        # shorter annotation reply lines are skipped
FACT_OBJECTS = 5               # objects kept in the published fact table
TEMPLATE_OBJECTS = 3           # objects kept in the annotation template
SPLIT_SEED = 42                # seed of the 1:2 split of the test set
