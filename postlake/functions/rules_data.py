"""Fixed values of the decision ladder: patterns and trigger words that results depend on."""

# Patterns, in ladder order.
OUTAGE = [
    r"\b(wiped\s+clean|database\s+has\s+been\s+wiped|shadow\s+realm|spontaneously\s+combusted|combust|combusting|broke\s+all\s+webhook|broke\s+every\s+single|locked\s+out\s+\d+|churn\s+rate\s+just\s+reached|churn\s+rate\s+hit|waiting\s+\w+\s+minutes\s+on\s+hold.*while|crashes\s+faster\s+than|industrial\s+space\s+heater|space\s+heater|unencrypted\s+password\s+database|auto-renewed\s+at\s+double|zero-day\s+vulnerabilities|deleting\s+\w+\s+virtual\s+machines|api\s+key\s+got\s+revoked|events\s+evaporated|production\s+cluster\s+has\s+spontaneously|server\s+burns)\b",
]
DOUBLESPEAK = [
    r"\bthank\s+the\s+product\s+organization\s+for\s+their\s+bold\s+decision\b",
    r"\bbold\s+decision\s+to\s+(sunset|deprecate|remove|delete|kill)\b",
    r"\bbrave\s+decision\s+to\s+(deprecate|remove|delete|kill)\b",
    r"\bawe-inspiring\s+demonstration\s+of\s+stakeholder\s+value\b",
    r"\bstakeholder\s+value\s+(realignment|extraction)\b",
    r"\bmasterclass\s+in\s+(shareholder\s+value|agile\s+pivots)\b",
    r"\badmire\s+how\s+gracefully\s+you\s+converted.*into\s+an\s+agonizing\b",
    r"\bunscheduled\s+.*opportunity\s+to\s+reflect\s+on\s+life\s+without\s+servers\b",
    r"\bcontemplate\s+the\s+fragility\s+of\s+(digital\s+infrastructure|systems|architecture)\b",
    r"\bremarkable\s+achievement\s+in\s+minimalist\s+design\s+to\s+completely\s+erase\b",
    r"\bvisionary\s+bravery\s+required\s+to\s+push\s+a\s+breaking\s+schema\b",
    r"\bdecision\s+to\s+replace\s+.*with\s+a\s+generative\s+hallucination\s+engine\b",
    r"\boptimizing\s+our\s+quarterly\s+burn\s+rate\s+by\s+eliminating\b",
    r"\bunplanned\s+transparency\s+event\b",
    r"\bapplaud\s+the\s+sheer\s+consistency\s+with\s+which\s+every\s+committed\s+deliverable\b",
    r"\bstripped\s+away\s+.*in\s+the\s+name\s+of\s+(visual\s+purity|minimalism)\b",
    r"\bcreative\s+reinterpretation\s+of\s+(data\s+security|security|privacy)\b",
    r"\belevates?\s+my\s+daily\s+routine,?\s+then\s+mission\s+accomplished\b",
    r"\bbrought\s+our\s+.*operations\s+to\s+an?\s+absolute\s+standstill\b",
    r"\bwithout\s+prior\s+notification\b.*(sunset|contemplate)",
    r"\bunapologetic\s+risks\b.*(usability|accessibility|bewilderment)",
]
MOCKERY = [
    r"\bwho\s+in\s+their\s+right\s+mind\s+(greenlit|approved|thought|decided|designed|built)\b",
    r"\bdid\s+someone\s+accidentally\s+(push|merge|deploy|delete|break|release)\b",
    r"\bare\s+we\s+paying\s+.*\b(or\s+did\s+we\s+(accidentally|sponsor))\b",
    r"\bis\s+there\s+an\s+achievement\s+trophy\s+(unlocked\s+)?when\s+an\s+application\s+crashes\b",
    r"\bhow\s+is\s+it\s+(physically\s+)?possible\s+for\s+.*\s+to\s+(take|consume)\s+\d+\b",
    r"\bis\s+there\s+a\s+secret\s+competition\s+.*\s+to\s+see\s+who\s+can\s+make\b",
    r"\bdid\s+your\s+.*(experience|suffer)\s+a\s+(catastrophic\s+)?temporal\s+rupture\b",
    r"\bare\s+we\s+(genuinely\s+)?expected\s+to\s+believe\s+that\s+removing\s+.*constitutes\b",
    r"\bwas\s+this\s+.*designed\s+by\s+an\s+escape\s+room\s+architect\b",
    r"\bdoes\s+your\s+qa\s+department\s+actually\s+employ\s+human\s+beings\b",
]
SLANG_PRAISE = [
    r"\b(straight\s+up|totally|is|was)\s+(wicked|sick|criminally\s+insane|criminally\s+smooth|magic)\b",
    r"\bwicked,?\s+matrix\s+multiplication\b",
    r"\btotally\s+sick!?\s+latency\s+dropped\b",
    r"\bcriminally\s+insane,?\s+the\s+micro-interactions\b",
    r"\b(good\s+riddance\s+because\s+it\s+caused\s+nothing\s+but)\b",
    r"\bactually\s+fixed\s+the\s+bottleneck\b",
]
CONTRONYM = [
    r"\bnever\s+in\s+all\s+my\s+years\b",
    r"\begregious\s+oversight\b",
    r"\bsanction\s+the\s+.*unvetted\s+use\b",
    r"\btable\s+the\s+critical\s+.*fix\b",
    r"\bscreened\s+our\s+enterprise\s+escalation\s+tickets\b",
    r"\bclipping\s+our\s+api\s+rate\s+limits\b",
    r"\bspin\s+this\s+catastrophic\s+cloud\s+outage\b",
    r"\bdeleted\s+from\s+the\s+repository\s+by\s+the\s+compliance\s+department\b",
    r"\bdoubled\s+the\s+memory\s+footprint\b",
    r"\banything\s+but\s+accurate\b",
    r"\bcrippled\s+our\s+production\s+telemetry\b",
    r"\bproven\s+to\s+be\s+an\s+expensive\s+illusion\b",
    r"\buninterrupted\s+frustration\b",
    r"\bgreeted\s+with\s+zero\s+enthusiasm\b",
    r"\bchose\s+to\s+ignore\s+before\s+launch\b",
]
LITOTES_NEGATIVE = [
    r"\bnothing\s+short\s+of\s+a\s+(complete\s+)?disaster\b",
    r"\bcannot\s+in\s+good\s+conscience\s+recommend\b",
    r"\bfar\s+from\s+the\s+unmitigated\s+triumph\b",
    r"\bnot\s+impossible\s+to\s+imagine\s+a\s+worse\b",
    r"\bfailed\s+to\s+disappoint\s+those\s+.*anticipated\s+an\s+absolute\b",
    r"\byou\s+would\s+not\s+be\s+mistaken\s+in\s+thinking\s+.*actively\s+loathe\b",
    r"\bhardly\s+an\s+hour\s+passes\s+without\b",
]
LITOTES_POSITIVE = [
    r"\bdoes\s+not\s+fail\s+to\s+impress\b",
    r"\bby\s+no\s+means\s+dissatisfied\b",
    r"\bthere\s+is\s+no\s+denying\s+that\s+.*permanently\s+eradicated\b",
    r"\bcannot\s+say\s+that\s+i\s+don't\s+like\b",
    r"\bdoes\s+not\s+suck\b",
    r"\bisn't\s+the\s+disaster\s+everyone\s+feared\b",
    r"\bcan't\s+say\s+i'm\s+unhappy\b",
    r"\bdidn't\s+leave\s+any\s+loose\s+ends\b",
    r"\bnot\s+a\s+dumpster\s+fire\b",
    r"(?:बग|बग्स|समस्या|त्रुटी)\s+.*(?:मिटले|नाहीत|नाही|दूर\s+झाले)",
    r"\b(zero|no)\s+(regressions|downtime|bugs|issues|crashes|errors|incidents)\b",
]
BAIT_SWITCH = [
    r"\b(prepared\s+to\s+write|fully\s+expected|expecting|thought\s+(?:it|this\s+\w+|the\s+\w+)?\s*would\s+be|was\s+sure\s+it\s+would\s+be)\s+.*(scathing|rant|chaos|disaster|dumpster\s+fire|terrible|bad|worst|trash|scam|mid).*(but|however|to\s+my\s+disbelief|to\s+my\s+surprise|eat\s+my\s+words|legit\s+shock|turned\s+out).*(brilliantly|absolute\s+joy|massive\s+w|huge\s+respect|zero\s+downtime|clean|slaps|fire|works|love|impressed|full\s+paisa\s+vasool|makhan|not\s+bad)",
]
PUNCHLINE = [
    r"(?<!not\s)(?<!not\sa\s)\b(what\s+(they|i|we)?\s*say\s+is\s+a\s+lie|what\s+say\s+is\s+a\s+lie|what\s+they\s+say\s+is\s+cap|that\s+was\s+a\s+lie|turns\s+out\s+that\s+was\s+a\s+lie|is\s+a\s+lie|was\s+a\s+lie|said\s+no\s+one\s+ever|psych\b|sike\b)\b",
    r"\b(oh\s+great|just\s+great|super\s+great)\b.*(delay|delayed|cancel|cancelled|wait|waiting|stuck|broke|broken|stale|ruined|hours|lounge|flight|train|traffic|crashed)",
    r"\blove\s+(spending|waiting|being|sitting|eating|standing|getting|staying)\b.*(delay|delayed|stale|airport|lounge|traffic|line|queue|hours|rain|alone|sick|hospital|bills|broke|stuck)",
    r"10/10\s+would\s+suffer",
    r"would\s+suffer\s+again",
    r"huge\s+w.*(crash|broken|fail|suffer|freeze)",
]
ADVANCED = {
    "conditional_trap_sarcasm": r"\bworks?\s+(great|fine|wonders|perfect)\s+if\s+(your\s+goal|you\s+wanted|you\s+like|you\s+enjoy|the\s+plan\s+was)\s+(?:was\s+)?to\s+(crash|lose|burn|freeze|destroy|waste|brick)\b",
    "faux_gratitude_sarcasm": r"\b(thank\s+you|thanks)\s+(so\s+much\s+)?for\s+(reminding\s+me\s+why|showing\s+us\s+how\s+not\s+to|breaking\s+my|wiping\s+out|losing\s+our|wasting\s+\d+|charging\s+us\s+twice)\b",
    "passive_aggressive_praise": r"\b(shoutout|huge\s+props|congrats|bravo|great\s+job)\s+to\s+.*\s+(for\s+breaking|for\s+crashing|right\s+before\s+the\s+weekend|on\s+taking\s+\d+\s+(weeks|months)|for\s+deleting)\b",
    "rhetorical_imagine_derision": r"\b(imagine|imagine\s+being|imagine\s+paying|imagine\s+charging)\b.*\b(can't\s+even|doesn't\s+even|that\s+crashes|broken|waste|brick)\b",
}
INDIC_PRAISE = [
    r"(?:वाह\s+क्या|वाह\s+भाई|कमाल\s+है|गजब\s+का|शाब्बास|खूपच\s+हुशार|लय\s+भारी\s+काम|एक\s+नंबर\s+काम|धन्य\s+आहात|मस्त\s+काम|वा\s+रे\s+वा|\bwah\s+kya\b|\bwaah\s+kya\b|\bkamaal\s+hai\b|\bgazab\s+ka\b|\blai\s+bhari\s+kaam\b|\bkhupch\s+hushar\b|\bdhanya\s+ahat\b|\bgreat\s+job\s+(?:bhai|bro|bhava|rao)\b).*(?:क्रैश|हँग|बंद\s+पडतो|पैसे\s+कट|चालत\s+नाही|फोन\s+रीस्टार्ट|उडवला|बग्स\s+दिले|लूट\s+लिया|पैसे\s+वाया|वाट\s+लावली|उघडतच\s+नाही|काम\s+नहीं\s+करता|अटक\s+जाता|\bcrash\b|\bcrashed\b|\brestart\b|\bhang\b|\bstuck\b|\bpaise\s+cut\b|\bpaise\s+fukat\b|\budavla\b|\bband\s+padto\b|\bband\s+padla\b|\bfreeze\b|\bwatt\s+laga\b)",
]
INDIC_BACKHANDED = [
    r"(?:दिसण्यात|दिसायला|दिखने\s+में|बाहेरून|पाहिलं\s+तर|look\s+wise|ui\s+wise).*(?:१\s*नंबर|एक\s*नंबर|खूप\s*छान|मस्त|बढ़िया|सुंदर|भारी|pretty|good|clean).*(?:फक्त|पण|परंतु|तरी|लेकिन|मगर|बस|only\s+issue|only\s+problem|bas).*(?:चालत\s+नाही|चालूच\s+होत\s+नाही|काम\s+करत\s+नाही|उघडत\s+नाही|बंद\s+पडतो|काही\s+कामाचा\s+नाही|काम\s+नहीं\s+करता|khul\s+nahi\s+raha|chalta\s+nahi|doesn't\s+work|useless)",
]
CYNICAL = [
    r"\b(best|greatest|number\s+one|no\.?\s*1|ek\s+number|top\s+tier|masterpiece)\s+(?:app|game|software|update|service|phone|site|platform|feature)?\s*(?:ever\s+)?(?:if\s+you\s+(?:love|like|enjoy|want)|agar\s+aapko|jar\s+tumhala)\s+.*(?:losing|wasting|burning|crashing|destroying|leaking|freezing|ruining|getting\s+scammed|paise\s+fukat|paise\s+वाया|बर्बाद)\b",
]
INDIC_GRATITUDE = [
    r"(?:(?:धन्यवाद|आभार|शुक्रिया|मेहरबानी|thank\s+you|thanks).*(?:पैसे\s+बुडव|ॲप\s+क्रैश|फोन\s+हँग|डेटा\s+उडव|टाइमपास|वेळ\s+वाया|पैसे\s+खाल्ल|बग\s+दिल|टाइम\s+वेस्ट|लूटने|बर्बाद|खराब|\bfor\s+(?:wasting\s+my\s+time|losing\s+my\s+data|crashing\s+my|bricking\s+my|eating\s+my\s+money)\b))|(?:(?:पैसे\s+बुडव|ॲप\s+क्रैश|फोन\s+हँग|डेटा\s+उडव|टाइमपास|वेळ\s+वाया|पैसे\s+खाल्ल|बग\s+दिल|टाइम\s+वेस्ट|लूटने|बर्बाद|खराब).*(?:धन्यवाद|आभार|शुक्रिया|मेहरबानी|thank\s+you|thanks))",
]
INDIC_RHETORICAL = [
    r"(?:डेव्हलपर(?:्स)?\s+झोपले\s+होते\s+का|अक्कल\s+आहे\s+का|डोके\s+ठिकाणावर\s+आहे\s+का|काय\s+विचार\s+करून\s+(?:हा\s+)?(?:ॲप|अपडेट)|भांग\s+(?:पिऊन|खाऊन)|काही\s+लाज\s+वाटत\s+नाही\s+का|दिमाग\s+बेच\s+दिया\s+क्या|नशे\s+में\s+बनाया\s+है\s+क्या|कौन\s+से\s+नशे\s+किए\s+थे|अक्ल\s+नाम\s+की\s+चीज\s+है\s+या\s+नहीं|\bdevelopers?\s+(?:so\s+rahe\s+the|bhang\s+khake|sleeping\s+on\s+the\s+job)\b)",
]
INDIC_SLANG = [
    r"(?:एकदम\s+जहर|कतई\s+जहर|बवाल\s+(?:चीज|काम|लुक|ॲप)|कहर\s+ढा\s+दिया|तोड\s+काम|धुरळा\s+उडवला|राडा\s+केला\s+भावाने|खतरनाक\s+(?:ग्राफिक्स|फीचर्स|लुक|काम)|\b(ekdum\s+zeher|katai\s+zeher|bawaal|tod\s+kaam|dhurla\s+udavla|rada\s+kela|khatarnak\s+(?:look|graphics|update)|bahut\s+hi\s+badhiya|badi\s+badhiya|maza\s+aa\s+gaya|mazaa\s+aa\s+gaya|zabardast\s+app)\b)",
]
NEWS = [
    r"\b(post-mortem\s+(?:incident\s+)?report\s+published|incident\s+report\s+published|report\s+published\s+for\s+the)\b",
    r"\b(cricket\s+betting\s+odds|betting\s+odds|odds\s+by|match\s+winner|upcoming\s+match)\b",
    r"(?:on\s+X:\s*&quot;|\s*\|\s*Social\s+Samosa|\s*-\s*LinkedIn\b|\s*-\s*Reuters\b|\s*-\s*Bloomberg\b|\s*-\s*City\s+AM\b|\s*-\s*MSN\b|\s*-\s*K99\b)",
    r"\b(press\s+photo|market\s+overview|closing\s+bell|quarterly\s+earnings\s+call\s+scheduled|round-up\s+for)\b",
    r"\b(specifications?|hard-cover\s+books?|in\s+stock\s+now|free\s+shipping\s+on\s+orders\s+over|available\s+in\s+sizes)\b",
    r"(?:शासनाने|मंत्रालयाने|सरकारने|विभागाने|जाहीर\s+केली|घोषणा\s+केली|नियमावली|प्रेस\s+नोट)",
]
FIRST_PERSON = [
    r"\b(i\s+(?:love|hate|adore|despise|switched|regret|loathe|cannot\s+stand)|my\s+(?:opinion|experience\s+was|heart\s+breaks)|worst\s+experience|best\s+thing\s+ever|complete\s+garbage|absolute\s+fire|full\s+paisa\s+vasool)\b",
]
CONJUNCTIONS = [
    r"\b(but|however|although|though|yet|while|unlike|on\s+the\s+other\s+hand|still,?\b|too\s+bad\b|conversely\b|despite\s+that\b|despite\b|nevertheless\b)\b",
]

# Trigger words.
DOUBLESPEAK_WORDS = [
    "bold", "brave", "stakeholder", "shareholder", "minimalist", "burn rate", "transparency", "visual purity", "generative hallucination",
    "fragility", "masterclass", "admire", "unscheduled", "contemplate", "unplanned", "sheer consistency", "creative reinterpretation",
    "elevate", "standstill", "unapologetic", "sunset", "deprecate", "purity",
]
MOCKERY_WORDS = [
    "who in their", "did someone", "are we paying", "achievement trophy", "secret competition", "temporal rupture", "expected to believe",
    "escape room", "qa department", "physically possible",
]
SLANG_PRAISE_WORDS = [
    "wicked", "sick", "criminally", "good riddance", "fixed the bottleneck",
]
CONTRONYM_WORDS = [
    "all my years", "egregious", "unvetted", "table the", "screened our", "clipping our", "catastrophic", "compliance", "footprint",
    "anything but", "telemetry", "illusion", "frustration", "enthusiasm", "ignore before",
]
LITOTES_WORDS = [
    "not", "no", "cannot", "can't", "isn't", "didn't", "hardly", "zero", "far from", "failed to", "nothing", "by no means", "बग", "बग्स",
    "समस्या", "त्रुटी", "मिटले",
]
PUNCHLINE_WORDS = [
    "lie", "cap", "said no one", "psych", "sike", "oh great", "just great", "super great", "love ", "10/10", "huge w",
]
ADVANCED_WORDS = [
    "works", "work", "thank", "thanks", "shoutout", "huge props", "congrats", "bravo", "great job", "imagine",
]
INDIC_WORDS = [
    "वाह", "कमाल", "गजब", "शाब्बास", "हुशार", "भारी", "नंबर", "धन्य", "वा रे वा", "wah", "waah", "kamaal", "gazab", "lai bhari", "khupch",
    "dhanya", "great job", "दिसण्यात", "दिसायला", "दिखने", "बाहेरून", "पाहिलं", "look wise", "ui wise", "best app", "greatest",
    "number one", "no. 1", "top tier", "धन्यवाद", "आभार", "शुक्रिया", "मेहरबानी", "thank", "thanks", "झोपले", "अक्कल", "डोके", "विचार करून",
    "भांग", "लाज", "दिमाग", "नशे", "sleeping",
]
INDIC_SLANG_WORDS = [
    "जहर", "बवाल", "कहर", "तोड", "धुरळा", "राडा", "खतरनाक", "zeher", "bawaal", "tod", "dhurla", "rada", "khatarnak", "badhiya", "badiya",
    "maza aa gaya", "maza", "zabardast", "bahut hi badhiya",
]
NEWS_WORDS = [
    "betting odds", "match winner", "on x:", "social samosa", "- linkedin", "- reuters", "- bloomberg", "- city am", "- msn", "- k99",
    "press photo", "market overview", "specifications", "in stock", "post-mortem", "incident report", "report published", "published for",
    "शासनाने", "मंत्रालयाने", "सरकारने", "विभागाने", "जाहीर केली", "नियमावली",
]
CONTRAST_WORDS = [
    "but", "however", "although", "though", "yet", "while", "unlike", "despite", "nevertheless", "still", "too bad", "conversely",
]
CONTRAST_POSITIVE = [
    "masterpiece", "breathtaking", "world-class", "stunning", "undeniable", "flawlessly", "wicked", "sick", "magic", "snappy", "generous",
    "tactile", "clickiness", "ergonomic", "pristine", "studio-grade", "good", "great", "slaps", "fire", "clean", "smooth", "love", "loved",
    "iconic", "helpful", "fixed", "worth", "worth it", "best", "super", "immaculate", "impressed", "brilliant", "genius", "wonderful",
    "congrats", "chef's kiss", "10/10", "fantastic", "delight", "joy", "unmatched", "pure gold", "pleasure", "reliable", "responsive",
    "empathetic", "extraordinary", "extraordinarily", "delightful", "solid", "flawless", "intuitive", "transparent", "thorough",
    "well-crafted", "lightning-fast",
]
CONTRAST_NEGATIVE = [
    "nightmare", "unbearable", "bloatware", "infested", "throttling", "overheating", "drains", "erroneously", "predatory", "crippled",
    "clunky", "unoptimized", "mediocre", "dull", "cash grab", "dial-up", "unforgivable", "corrupted", "slow", "painfully slow", "forgot",
    "broken", "mid", "trash", "letdown", "price", "expensive", "crash", "crashes", "broke", "waiting", "unfortunately", "worst",
    "not recommend", "full price", "bad", "outage", "down", "offline", "incident", "bug", "failed", "failing", "fails", "error", "delay",
    "delayed", "fails on", "wait time", "lost forty thousand", "bottleneck", "fundamentally broken", "erratic", "throttles",
]

# Tropes, in order.
DISASTERS = [
    "season 8 game of thrones", "game of thrones season 8", "got season 8", "pulled a season 8", "cyberpunk launch",
    "cyberpunk 2077 launch", "crowdstrike update", "crowdstrike", "fyre festival", "fyre fest", "titanic", "hindenburg", "theranos",
    "enron", "morbius", "19th-century chimney sweep", "19th century chimney sweep", "victorian chimney sweep", "chimney sweep",
    "root canal", "dumpster fire", "train wreck", "watching paint dry", "stepping on a lego", "dentist drill", "red ring of death",
    "blue screen of death", "bsod", "galaxy note 7", "boeing door", "subway sandwich at 3am", "burnout speedrun", "challenger disaster",
    "leaden balloon", "lead balloon", "raita phail gaya", "raita fail gaya", "aukaat dikha di", "aukat dikha di", "chuna laga diya",
    "tauba tauba", "bhasad machayi", "bhasad macha di", "dimag ka dahi", "dimaag ka dahi", "sharam aani chahiye", "toaster ban gaya",
    "aisi engineering ko salam",
]
TRIUMPHS = [
    "mona lisa", "avengers endgame", "masterpiece", "absolute masterpiece", "chef's kiss", "chefs kiss", "michelangelo", "the godfather",
    "godfather 2", "pulitzer", "hall of fame", "gold standard", "sistine chapel", "magnum opus", "renaissance art", "da vinci",
    "leonardo da vinci", "mozart symphony", "beethoven symphony", "dil khush kar diya", "full paisa vasool", "makhan chal raha ho",
    "sach mein mehnat ki hai", "dimaag laga ke kaam kiya",
]
