"""Fixed values of aspect sentiment: aspect keywords and signal words."""

# Keywords of each aspect.
ASPECTS = {
    "ui_ux": [
        "ui", "ux", "design", "look", "looks", "clean", "theme", "aesthetic", "aesthetics", "button", "buttons", "layout", "animation",
        "animations", "screen", "screens", "interface", "visual", "visuals", "dark mode", "font", "fonts", "colors", "typography",
        "visual masterpiece", "micro-interactions", "contrast", "palette", "canvas", "दिसतो", "दिसते", "दिखने में", "स्क्रीन", "थीम", "बटण",
        "बटन", "फॉन्ट", "डिझाइन", "डिजाइन", "लुक", "रंग",
    ],
    "performance": [
        "speed", "fast", "slow", "slower", "lag", "lagging", "smooth", "smoother", "crash", "crashes", "crashed", "crashing", "freeze",
        "freezes", "frozen", "bug", "bugs", "buggy", "glitch", "glitches", "memory", "battery", "cpu", "watt laga di", "load time",
        "loading", "optimize", "optimized", "latency", "query latency", "backend query", "throughput", "overheating", "thermal throttling",
        "kernel panic", "space heater", "packet loss", "frame drops", "netcode", "audio compression", "transcription speed", "bottleneck",
        "timing out", "timeout", "timeouts", "database", "connection pool", "स्पीड", "हँग", "हॅंग", "क्रैश", "स्लो", "गती", "फास्ट", "बग",
        "बग्स", "बंद पडतो", "बंद पडतोय", "चालत नाही", "खराब चालतो",
    ],
    "customer_support": [
        "support", "service", "customer support", "customer service", "agent", "agents", "ticket", "tickets", "response", "refund",
        "refunds", "email", "helpdesk", "live chat", "ghosted", "call", "representative", "customer success", "tier-one", "tier-two",
        "support desk", "escalation", "help desk", "मदत", "सपोर्ट", "कॉल", "सेवा", "सर्व्हिस", "ग्राहक सेवा", "उत्तर", "मदत मिळत नाही",
    ],
    "pricing_value": [
        "price", "pricing", "cost", "subscription", "cheap", "expensive", "ripoff", "rip off", "rip-off", "scam", "paisa vasool",
        "paisa wasool", "worth it", "waste of money", "loot liya", "chindi", "paywall", "affordable", "shareholder value", "licensing",
        "annual renewal", "price hikes", "auto-renewed", "annual contract", "billing", "charges", "charged", "पैसे", "किंमत", "महाग",
        "खर्च", "स्वस्त", "लूट", "सबस्क्रिप्शन", "पैसे वाया", "पैसे फुकट",
    ],
    "features": [
        "feature", "features", "update", "patch", "tool", "tools", "mode", "matchmaking", "export", "exports", "dashboard", "functionality",
        "weapons", "release", "sdk", "sdks", "driver", "webhook", "webhooks", "search index", "filter", "modal", "reporting", "integration",
        "integrations", "documentation", "api", "फीचर", "फीचर्स", "अपडेट", "नवीन", "साधन", "टूल",
    ],
}
# Signal words.
POSITIVE = [
    "fire", "slap", "slaps", "clean", "smooth", "fast", "goated", "w", "huge w", "love", "amazing", "great", "good", "perfect",
    "chef's kiss", "immaculate", "op", "mast", "ekdum mast", "cracked", "bawaal", "jhakaas", "paisa vasool", "solid", "awesome", "helpful",
    "responsive", "quick", "affordable", "worth", "worth it", "masterpiece", "breathtaking", "world-class", "stunning", "undeniable",
    "flawlessly", "wicked", "sick", "magic", "snappy", "generous", "tactile", "clickiness", "ergonomic", "pristine", "studio-grade",
    "unmatched", "brilliant", "delight", "joy", "lai bhari", "lay bhari", "khup chhan", "ek number", "kadak", "bhari", "shandar", "badhiya",
    "छान", "मस्त", "उत्तम", "सुंदर", "बढ़िया", "शानदार", "लाजवाब", "झकास", "कडक", "भारी", "चांगला", "चांगली", "चांगले", "सोपा", "सोपी",
    "सोपे", "सुरक्षित", "सर्वोत्तम",
]
NEGATIVE = [
    "trash", "garbage", "mid", "cooked", "crash", "crashes", "slow", "slower", "bug", "bugs", "buggy", "l", "huge l", "flop", "scam",
    "hate", "terrible", "worst", "broken", "bricked", "annoying", "cringe", "confusing", "fumble", "watt laga di", "dimaag kharab",
    "loot liya", "stupid", "ripoff", "rip-off", "rip off", "ghosted", "unresponsive", "waste", "useless", "overpriced", "fails", "failed",
    "fail", "glitch", "glitches", "lag", "lagging", "chindi", "nightmare", "unbearable", "bloatware", "infested", "throttling",
    "overheating", "drains", "erroneously", "predatory", "crippled", "clunky", "unoptimized", "mediocre", "dull", "cash grab", "dial-up",
    "unforgivable", "corrupted", "crashed", "crashing", "leak", "leaks", "leaked", "critical", "timeout", "timeouts", "timing out",
    "exhausted", "failing", "paise fukat", "paise vaya", "kahi upyog nahi", "band padto", "chalat nahi", "doke dukhi", "faltu", "bakwas",
    "घटिया", "बकवास", "बेकार", "खराब", "फालतू", "कचरा", "रद्दी", "धोखा", "लूट", "त्रास", "बग", "बग्स", "क्रैश", "हँग", "स्लो", "हळू",
    "महाग", "बंद पडतो", "चालत नाही", "वाईट",
]
