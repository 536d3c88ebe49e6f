"""Word lists, patterns and constants that the results depend on.

Everything in this module is data.  The values must equal the ones of the
analyses this library reproduces, otherwise scores, labels and keyword hits
would differ.  Every list can be replaced by a caller's own (see ``rules.py``).

A phrase may hold ``{brand}``: the name of the company whose conversations are
analysed.  Such phrases take part only when a brand is given.
"""

# --------------------------------------------------------------------------
# Labels and their scores
# --------------------------------------------------------------------------
LABELS = ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative"]

LABEL_SCORES = {
    "Very Positive": 0.85,
    "Positive": 0.35,
    "Neutral": 0.0,
    "Negative": -0.55,
    "Very Negative": -0.85,
}

DISPLAY_LABELS = {
    "Very Positive": "🟢 Very Positive",
    "Positive": "🟡 Positive",
    "Neutral": "⚪ Neutral",
    "Negative": "🟠 Negative",
    "Very Negative": "🔴 Very Negative",
}

# lowest score of each label, from the top; below the last one: Very Negative
LABEL_BOUNDS = [0.60, 0.20, -0.20, -0.60]
WIDE_LABEL_BOUNDS = [5.0, 1.0, -2.0, -3.0]

# --------------------------------------------------------------------------
# Column and format detection
# --------------------------------------------------------------------------
ID_COLUMN_NAMES = [
    "Conversation Id", "Conversation ID", "conversation_id",
    "CS Ticket ID", "Ticket ID", "ID", "Id", "id",
]
OVERRIDE_ID_NAMES = ["ID", "PPTLEADS_COMM_ID", "TICKET ID", "TICKET_ID"]
OVERRIDE_LABEL_NAME = "actual sentiment"

FORMAT_BRACKET = r"\[\d{2}:\d{2}:\d{2}\s+(CUSTOMER|AGENT|CONSUMER)\]:"
FORMAT_PIPE_DATED = r"(?:\|\s*)?\d{4}-\d{2}-\d{2}.*?Consumer:"
FORMAT_PIPE = r"Consumer:"
FORMAT_TAGGED = r"<b>\d{2}:\d{2}:\d{2}"
FORMAT_SMS = r"\d{2}:\d{2}:\d{2}\s+\w[\w ]+\s*:\s+\w"

# --------------------------------------------------------------------------
# transcripts
# --------------------------------------------------------------------------
TAGGED_TURN = r"<b>(\d{2}:\d{2}:\d{2})\s+([^:]+?)\s*:\s*</b>([^<]+?)(?:<br\s*/?>|$)"
SMS_TURN = r"(\d{2}:\d{2}:\d{2})\s+([^:]+?)\s*:\s*(.+?)(?=\d{2}:\d{2}:\d{2}\s+|$)"
BRACKET_TURN = r"\[\d{2}:\d{2}:\d{2}\s*CUSTOMER\]:\s*(.*?)(?=\[\d{2}:\d{2}:\d{2}\s*\w+\]:|$)"
SMS_NOISE = [
    r"\d{4}-\d{2}-\d{2}T[\d:.]+Z\w+$",
    r"Looks up Phone Number.*?digits-\d+",
    r"Looks up SSN number.*?digits-\d+",
    r"Phone Numbers rule for Chat",
    r"SSN rule for Chat",
]
AGENT_NAME_WORDS = [
    "agent", "support", "care", "service", "team", "rep", "representative",
    "advisor", "specialist", "associate", "staff", "bot", "system", "virtual",
    "assistant", "operator", "helpdesk", "help desk",
]

# --------------------------------------------------------------------------
# cleaning
# --------------------------------------------------------------------------
AGENT_REQUEST_PHRASES = [
    "chat with an agent", "chat with agent", "speak to agent", "talk to agent",
    "connect me to agent", "agent chat", "chat to agent", "agent help", "help chat",
]
MOJIBAKE = [("Ã±", "ñ"), ("Ã¡", "á"), ("Ã©", "é"), ("Ã\u00ad", "í"), ("Ã³", "ó"), ("Ãº", "ú")]
URL = r"https?://\S+|www\.\S+"
EMAIL_IN_REVIEW = r"\S+@\S+\.\S+"
HTML_TAG = r"<[^>]+>"
CONTROL_CHARACTERS = r"[\x00-\x1f\x7f-\x9f]"
REPEATED_PUNCTUATION = r"([!?.,])\1{1,}"
EMOJI = "[\U0001F300-\U0001F6FF\U0001F900-\U0001F9FF\U0001F1E0-\U0001F1FF\U00002700-\U000027BF]"

PII_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PII_PHONE = r"(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"
PII_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PII_CARD = r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13})\b"

# --------------------------------------------------------------------------
# Profile tagged_chat
# --------------------------------------------------------------------------
TAGGED_STRIP_NAMES = ["{brand}", "physical therapy", "pt session", "therapy session", "treatment session"]

TAGGED_VERY_NEGATIVE = [
    "worst experience", "absolutely terrible", "completely unacceptable",
    "never coming back", "will never use again", "horrible experience",
    "disgusted", "furious", "outraged", "scam", "fraud", "stealing my money",
    "sue", "lawyer", "legal action", "file a complaint", "report to",
    "better business bureau",
]
TAGGED_NEGATIVE = [
    "still have not received", "have not received", "not received",
    "money is debited", "money was debited", "money was withdrawn",
    "without my permission", "without permission", "without consent",
    "i do not want this", "did not want to renew", "thanks for nothing",
    "getting stuck", "notifications are getting stuck",
    "unable to do payment", "payment is pending", "payment failed",
    "frustrating", "frustrated", "annoyed", "angry", "upset",
    "disappointed", "terrible", "horrible", "worst",
    "unacceptable", "ridiculous", "pathetic", "useless",
    "not working properly", "doesn't work", "cant access", "cannot access",
    "not working", "stopped working", "hacked my account", "compromised account",
    "charged double", "overcharged", "incorrect charge",
    "unforeseen circumstances", "you dont want to help", "you don't want to help",
    "no help", "not helpful", "unhelpful", "waste of time", "wasting my time",
    "long wait", "waiting too long", "waited forever",
    "no improvement", "getting worse", "pain increased",
    "treatment didn't work", "not getting better",
    "no show", "didn't show up", "never showed",
    "rude", "unprofessional", "dismissive",
    "no response", "never called back", "ignored",
    "not resolved", "still not resolved", "problem persists",
]
TAGGED_NEUTRAL = [
    "cancel appointment", "reschedule", "change appointment",
    "need to cancel", "please cancel", "want to cancel",
    "want to reschedule", "need to reschedule",
    "move my appointment", "change my appointment time",
    "change email", "change my email", "update email",
    "change the email address", "need to change my email",
    "change my card", "change card details", "update payment",
    "remove payment method", "update my information",
    "verify my account", "need to update",
    "want my refund", "please refund", "need a refund",
    "issue a refund", "can you refund", "requesting refund",
    "how to", "how can i", "how do i", "can you help", "need help", "help me",
    "can i get", "is there any", "is it possible",
    "questions about", "just wondering", "what is", "where can i", "when will",
    "change plan", "switch plan", "upgrade", "downgrade", "change from", "switch to",
    "just canceled", "just cancelled", "finding current password", "reset password",
    "need to add", "want to add",
]
TAGGED_POSITIVE = [
    "thank you", "thanks", "thank u", "ty", "appreciate", "grateful", "thankful",
    "perfect", "great", "excellent", "awesome",
    "helpful", "very helpful", "super helpful",
    "wonderful", "fantastic", "amazing",
    "thanks for the quick reply", "thanks for your help",
    "appreciate you looking into", "appreciate your help",
    "thanks for clarifying", "thanks for explaining",
    "that works", "sounds good", "that's fine", "all set", "all good", "we're good",
]
TAGGED_VERY_POSITIVE = [
    "outstanding", "exceeded expectations", "extremely helpful", "incredibly helpful",
    "absolutely perfect", "best service", "highly recommend", "couldn't be better",
    "amazing service", "excellent service", "love it", "love this", "absolutely love",
]
TAGGED_STRONG = [
    "without my permission", "without permission", "do not want this", "did not want",
    "thanks for nothing", "unable to do payment", "payment failed",
    "still have not received", "never received",
    "long wait", "waiting too long", "waited forever",
    "no improvement", "getting worse", "pain increased", "treatment didn't work",
    "no show", "didn't show up", "rude", "unprofessional", "dismissive",
    "waste of time", "wasting my time", "not helpful", "no help",
    "not resolved", "problem persists",
]
TAGGED_RESOLUTION_PHRASES = [
    "thanks", "thank you", "thank u", "okay", "perfect", "got it", "understood",
    "appreciate", "sounds good", "all set", "all good", "we're good",
]
RESOLUTION_WORDS = ["ty", "ok"]
TAGGED_POSITIVE_WORDS = [
    "thank", "thanks", "appreciate", "perfect", "helpful", "great", "excellent", "awesome",
]

# --------------------------------------------------------------------------
# Profile bracket_chat
# --------------------------------------------------------------------------
BRACKET_STRIP_NAMES = [
    "stranger things", "the crown", "bridgerton", "squid game", "money heist",
    "ozark", "the witcher", "narcos", "breaking bad", "better call saul",
    "black mirror", "the umbrella academy", "cobra kai", "prison break",
    "you", "wednesday", "outer banks", "lucifer", "peaky blinders", "dark",
    "mindhunter", "the sinner", "how to get away with murder", "criminal minds",
    "the blacklist", "dexter", "bloodline", "kissing booth",
    "bon appetite", "bon appetit",
]
BRACKET_NEGATIVE = [
    "still have not received", "have not received", "not received",
    "money is debited", "money was debited", "money was withdrawn",
    "without my permission", "without permission",
    "i do not want this membership", "did not want to renew", "did not want to restart",
    "thanks for nothing", "notifications are getting stuck", "getting stuck",
    "unable to do payment", "payment is pending",
    "frustrating", "frustrated", "annoyed", "angry",
    "not working properly", "doesn't work", "cant access", "cannot access",
    "hacked my account", "compromised account",
    "charged double", "being charged double", "unforeseen circumstances",
    "you dont want to help", "you don't want to help",
]
BRACKET_NEUTRAL = [
    "want my refund back", "please refund", "need a refund",
    "issue a refund", "can you refund",
    "change email", "change my email", "update email", "switch to a different email",
    "change the email address", "need to change my email",
    "change my card", "change card details", "update payment",
    "remove payment method", "verify my account with a credit card",
    "change from premium to standard", "change plan", "switch plan",
    "automatically changed", "change from standard to premium",
    "how to", "how can i", "can i get", "is there any discount",
    "questions about", "just wondering", "need to add",
    "how to change", "help finding", "unable to access",
    "device is not part", "can not access from",
    "just canceled", "want to cancel", "can you cancel",
    "verify my account", "finding current password",
]
BRACKET_POSITIVE = [
    "thank you", "thanks", "appreciate", "grateful",
    "perfect", "helpful", "great", "excellent", "awesome",
    "super helpful", "very helpful", "wonderful",
    "thanks for the quick reply", "appreciate you looking into",
    "thanks for clarifying", "thanks for explaining",
]
BRACKET_VERY_POSITIVE = [
    "bon appetite", "bon appetit", "amazing", "outstanding", "exceeded expectations",
    "extremely helpful", "incredibly helpful", "absolutely perfect",
]
BRACKET_STRONG = [
    "without my permission", "do not want this membership", "did not want to renew",
    "thanks for nothing", "unable to do payment", "still have not received",
]
RESOLUTION_PHRASES = [
    "thanks", "thank you", "thank u", "okay", "perfect", "got it", "understood",
    "appreciate", "sounds good", "all set", "all good",
]
BRACKET_POSITIVE_WORDS = ["thank", "thanks", "appreciate", "perfect", "helpful"]

# --------------------------------------------------------------------------
# Profile pipe_chat
# --------------------------------------------------------------------------
PIPE_NEGATIVE = [
    "not happy", "difficult", "still can't", "can't make payment",
    "cannot make payment", "how much longer", "unwilling", "problem",
    "issue", "refund not", "angry", "complaint",
    "bad", "poor", "horrible", "terrible", "customer service", "no help",
    "not satisfied", "disappointed", "policies aren't", "not resolved",
    "not working", "doesn't work", "worse", "delay", "waiting too long",
    "frustrated", "cancel", "unacceptable",
]
PIPE_NEUTRAL = [
    "want to talk", "continue conversation", "verify my", "reach out",
    "need my {brand}", "staff was friendly", "my account is reverted",
    "I love {brand}", "label user", "no decline", "no billing",
    "ad is coming", "i want a refund", "refund", "switch", "changed",
    "changed my card", "i want to reach", "check my account",
    "contact support", "login", "sign in", "update account",
    "different subscription",
]

# --------------------------------------------------------------------------
# Profile pipe_or_plain
# --------------------------------------------------------------------------
PLAIN_NEGATIVE = [
    "dns locked", "locked a records", "can't change dns", "domain not showing",
    "domain not working", "site not visible", "cannot send email",
    "cannot receive email", "email not working", "auto renew",
    "unexpected renewal", "account locked", "account blocked",
    "otp not received", "code not received", "authenticator not working",
    "wordpress error", "media upload failing", "ssl not working",
    "certificate expired", "transfer domain", "transfer failed",
    "not working", "doesn't work", "problem", "issue",
    "frustrated", "angry", "terrible", "worst", "horrible",
    "no help", "not resolved", "waste of time",
]
PLAIN_NEUTRAL = [
    "how do i", "how can i", "can you help", "need help",
    "want to transfer", "want to cancel", "want to renew",
    "check my account", "verify my account", "update my",
    "change my", "set up", "configure", "connect my domain",
    "point my domain", "install", "how to setup",
]
PLAIN_STRONG = [
    "dns locked", "account locked", "account blocked",
    "cannot receive email", "cannot send email",
    "domain not working", "ssl not working", "transfer failed",
]

# --------------------------------------------------------------------------
# Profile review
# --------------------------------------------------------------------------
REVIEW_GROUPS = {
    "very_positive": [
        "excellent", "amazing", "outstanding", "brilliant", "superb",
        "fantastic", "awesome", "wonderful", "perfect", "exceptional",
        "mind blowing", "mind-blowing", "loved it", "absolutely love",
    ],
    "positive": [
        "very good", "engaging", "all good", "good going", "overall nice",
        "good", "interactive", "service", "experience", "product",
        "overall good", "everything good", "informative", "helpful", "great",
        "impressive", "valuable", "useful", "beneficial", "effective",
        "satisfactory", "satisfied", "pleased", "happy", "enjoy", "enjoyed",
        "nice session", "informative session", "good session", "great session",
        "well organized", "well done", "keep it up", "thank you", "thanks",
        "appreciate", "friendly", "professional", "approachable", "fun",
        "insightful", "cool", "looking forward", "excited", "like", "liked",
    ],
    "neutral_phrases": [
        "nothing else", "no additional comments", "no comments", "nothing",
        "nothing to add", "no comment", "none so far", "no other comment",
        "nothing more", "no more comments", "nothing specific",
        "nothing in particular", "okay", "fine",
    ],
    "negative_phrases": [
        "room was cold", "cold room", "cold board room", "feeling asleep",
        "no equipment", "had to write everything", "lack of equipment",
        "waste of time", "complete waste", "not worth", "didn't help",
    ],
    "very_negative": [
        "bad", "poor", "terrible", "awful", "worst", "horrible", "pathetic",
        "disappointing", "useless", "waste", "boring", "dull", "confusing",
        "frustrating", "annoying", "unpleasant", "uncomfortable", "disgusting",
        "hate", "hated", "disaster", "nightmare", "rubbish", "garbage",
    ],
    "moderate_negative": [
        "cold", "asleep", "feeling asleep", "sleepy", "tired", "exhausting",
        "no equipment", "no tools", "lack of", "missing", "insufficient",
        "had to write", "cramped", "difficult", "challenging",
        "issue", "problem", "concern",
    ],
}
REVIEW_GROUP_WEIGHTS = {
    "very_positive": 9.0,
    "positive": 7.0,
    "neutral_phrases": 0.0,
    "negative_phrases": -7.0,
    "very_negative": -9.0,
    "moderate_negative": -5.0,
}
# a word of each list, one after the other in one line
POSITIVE_OVERRIDES = [
    [["nothing"], ["happy", "good", "great", "excellent", "awesome", "perfect", "love", "amazing"]],
    [["no"], ["complain", "issue", "problem"], ["good", "great", "excellent"]],
]
POSITIVE_OVERRIDE_WEIGHT = 6.0

MEANINGLESS_TOKENS = ["na", "ma", "nil", "none", "non", "ok", "yes", "no"]
MEANINGLESS_SEPARATORS = r"[/\\|.\-?_ ]"
MEANINGLESS_PATTERNS = [
    r"^[a-zA-Z]$",
    r"^[0-9]+$",
    r"^(na|n/a|n\.a|n\|a|n\\a|n\?a|ma|n\./a|n-a)$",
    r"^(nil|none|non|nope)$",
    r"^(ok|okay|yes|no|y|n)$",
    r"^[^\w\s]+$",
    r"^(.)\1+$",
]

SPANISH_CHARACTERS = "áéíóúñüÃ"
SPANISH_WORDS = [
    "tengo", "nada", "mas", "que", "agregar", "muy", "esta", "dia",
    "gracias", "como", "mejorar", "estoy", "trabajo", "comentarios",
]
ENGLISH_WORDS = [
    "the", "is", "are", "was", "were", "have", "has", "had", "will",
    "i", "you", "he", "she", "it", "we", "they", "not", "all",
]
EASY_TRANSLATION_LANGUAGES = ["es", "fr", "pt", "it"]

# --------------------------------------------------------------------------
# Complaint dictionaries (category -> phrases)
# --------------------------------------------------------------------------
SHARED_DICTIONARY = {
    "payment_issues": [
        "money is debited", "money was debited", "money was withdrawn",
        "charged double", "being charged double", "double charged",
        "unauthorized charge", "charged without permission",
        "payment not going through", "unable to do payment",
        "payment is pending", "payment failed", "payment issue",
        "billing issue", "billing problem", "wrong amount charged",
        "overcharged", "charged incorrectly", "incorrect charge",
        "refund not received", "still waiting for refund",
    ],
    "access_issues": [
        "cannot access", "cant access", "can't access", "unable to access",
        "not working properly", "doesn't work", "does not work",
        "not working", "stopped working", "no longer works",
        "hacked my account", "account hacked", "compromised account",
        "locked out", "account locked", "suspended account",
        "login issue", "login problem", "can't login", "cannot login",
        "portal not working", "website down", "app not working",
    ],
    "delivery_issues": [
        "still have not received", "have not received", "not received",
        "did not receive", "never received", "haven't received",
        "waiting for", "still waiting", "no response",
        "not delivered", "delivery failed", "never got",
    ],
    "unwanted_actions": [
        "without my permission", "without permission", "without consent",
        "i do not want this", "did not want to renew",
        "did not want to restart", "didn't want to renew",
        "auto renewed", "automatically renewed", "renewed without asking",
        "charged after cancellation", "cancelled but charged",
        "didn't authorize", "unauthorized",
    ],
    "technical_issues": [
        "notifications are getting stuck", "getting stuck", "stuck",
        "error message", "error occurred", "system error",
        "technical issue", "technical problem", "glitch",
        "buffering issue", "streaming problem", "won't load",
        "keeps crashing", "app crashes", "freezing",
        "not loading", "page not loading",
    ],
    "frustration": [
        "frustrating", "frustrated", "annoyed", "angry",
        "disappointed", "upset", "irritated", "furious",
        "unacceptable", "ridiculous", "terrible", "horrible",
        "worst", "pathetic", "useless", "awful",
        "disgusted", "fed up", "sick of", "tired of",
        "not happy", "unhappy", "dissatisfied",
    ],
    "poor_service": [
        "thanks for nothing", "no help", "not helpful", "unhelpful",
        "you dont want to help", "you don't want to help",
        "waste of time", "wasting my time", "poor service",
        "bad service", "terrible service", "worst service",
        "no support", "poor support", "terrible support",
        "unprofessional", "rude", "disrespectful",
    ],
    "resolution_issues": [
        "not resolved", "still not resolved", "unresolved",
        "no solution", "not fixed", "still broken",
        "problem persists", "issue continues", "still having issues",
        "unforeseen circumstances", "unexpected problem",
        "still experiencing", "ongoing issue",
    ],
    "general_negative": [
        "problem", "issue", "concern", "complaint",
        "trouble", "difficulty", "struggle",
        "wrong", "incorrect", "mistake", "error",
        "broken", "damaged", "defective",
        "lost", "missing", "disappeared",
        "failed", "failure", "unsuccessful",
    ],
}
TAGGED_DICTIONARY = {
    "appointment_issues": [
        "missed appointment", "late appointment", "wrong appointment",
        "appointment not scheduled", "double booked", "no appointment available",
        "long wait time", "waiting too long", "waited forever",
        "no show", "didn't show up", "never showed",
        "cancelled my appointment", "appointment was cancelled",
        "rescheduled without notice", "changed without telling me",
        "therapist didn't show", "no therapist available",
        "running late", "always late", "never on time",
    ],
    "treatment_issues": [
        "treatment didn't work", "no improvement", "getting worse",
        "pain increased", "not getting better", "ineffective treatment",
        "wrong diagnosis", "misdiagnosed", "incorrect treatment",
        "not helping", "doesn't help", "no progress",
        "condition worsened", "more pain", "hurts more",
    ],
    "communication_issues": [
        "no response", "didn't respond", "no callback", "never called back",
        "ignored my request", "no follow up", "poor communication",
        "never heard back", "no one contacted me",
        "didn't call me back", "no one called", "unreachable",
        "can't reach anyone", "no answer", "not responding",
    ],
    "staff_issues": [
        "rude staff", "unprofessional staff", "incompetent",
        "didn't listen", "ignored me", "dismissive",
        "not trained", "inexperienced", "careless",
        "rushed through", "didn't care", "indifferent",
    ],
    "billing_insurance": [
        "insurance not accepted", "insurance issue", "insurance problem",
        "claim denied", "not covered", "out of network",
        "surprise bill", "unexpected charge", "hidden fee",
        "wrong insurance", "billing error",
    ],
    "insurance_verification": [
        "are you in-network", "out-of-network", "in network",
        "do you accept", "accept my insurance", "verify my insurance",
        "insurance verification", "check my coverage", "coverage verification",
        "do i have visits left", "visits remaining", "how many visits",
        "insurance eligibility", "benefits check", "prior authorization",
        "pre-authorization", "referral required", "need a referral",
    ],
    "new_patient_intake": [
        "new patient", "first appointment", "first visit", "first time",
        "how do i sign up", "register as a patient", "intake form",
        "patient registration", "pricing of services", "how much does it cost",
        "i have a referral", "referral from my doctor",
        "what do i need to bring", "initial evaluation",
        "onboarding", "new client",
    ],
    "location_availability": [
        "nearest location", "closest office", "which office",
        "location not available", "no office near me", "too far",
        "branch not available", "no therapist at this location",
        "office hours", "location hours", "is there a clinic",
        "which clinic", "closest clinic",
    ],
    "condition_specific": [
        "torn meniscus", "lower back pain", "back pain",
        "myofascial pain", "knee pain", "shoulder pain",
        "hip pain", "neck pain", "spine", "herniated disc",
        "rotator cuff", "tendonitis", "sciatica", "post surgery",
        "post-surgery", "after surgery", "surgery recovery",
        "chronic pain", "sports injury", "accident injury",
        "physical injury", "muscle strain", "joint pain",
    ],
}
BRACKET_DICTIONARY = {
    "unwanted_actions": ["i do not want this membership"],
    "account_verification": [
        "cannot verify account", "can't verify account",
        "otp not received", "code not received", "didn't receive code",
        "email link not received", "verification email not received",
        "mfa not working", "two factor not working", "2fa issue",
        "change email", "update email", "change my email",
        "email not working", "cannot change email",
        "phone number not accepted", "number not verified",
    ],
    "geographic_access": [
        "moved to", "relocated to", "can't access from",
        "service not available in", "region locked", "not available in my country",
        "geo restricted", "country not supported", "blocked in my region",
        "different country", "international access", "vpn required",
    ],
    "security_block": [
        "multiple attempts to make changes", "account locked for security",
        "unable to process modifications", "security hold",
        "flagged for security", "suspicious activity",
        "account under review", "blocked for security",
        "security verification failed", "locked due to",
    ],
    "plan_change": [
        "change plan", "switch plan", "change to premium",
        "change to standard", "tier upgrade failed",
        "upgrade failed", "downgrade failed", "plan not updated",
        "why can't i subscribe", "subscription not changing",
        "plan change not applied", "still on old plan",
    ],
}
PIPE_DICTIONARY = {
    "payment_issues": [
        "can't make payment", "cannot make payment", "refund not",
        "billing", "overcharged", "charged incorrectly",
    ],
    "access_issues": [
        "not working", "doesn't work", "login", "sign in",
        "locked out", "account locked",
    ],
    "frustration": SHARED_DICTIONARY["frustration"],
    "service_issues": [
        "customer service", "no help", "not resolved",
        "complaint", "delay", "waiting too long",
        "difficult", "unwilling", "policies aren't",
    ],
    "general_negative": ["problem", "issue", "cancel", "still can't", "how much longer"],
    "student_plan": [
        "student account", "student plan", "student pricing",
        "education discount", "student discount",
        "price increased from", "student verification failed",
        "student rate not applied", "no longer student rate",
        "student membership", "academic plan",
    ],
    "artist_account": [
        "artist page claim", "can't claim artist page",
        "claim my artist profile", "artist verification",
        "music distribution", "getting music on {brand}",
        "submit music", "artist access denied",
        "{brand} for artists", "artist dashboard",
        "my artist profile", "artist account issue",
    ],
    "payment_method_switch": [
        "charge different card", "change payment method",
        "update card details", "change my card",
        "switch payment", "different credit card",
        "add new card", "remove old card", "payment card update",
        "change billing card", "update billing method",
    ],
    "cancellation_timing": [
        "cancel premium", "when does cancellation take effect",
        "downgrade confusion", "cancellation not applied",
        "still being charged after cancel", "cancel effective date",
        "when will cancellation apply", "cancellation pending",
        "still subscribed after cancel", "downgrade to free",
    ],
}
PLAIN_DICTIONARY = {
    "dns_configuration": [
        "dns locked", "locked dns", "can't change dns", "cannot change dns",
        "dns settings locked", "a record locked", "locked a records",
        "nameserver", "name server", "dns record", "multiple a records",
        "a record issue", "cname issue", "mx record", "dns not updating",
        "dns propagation", "dns not working", "dns configuration",
        "change nameserver", "point domain", "domain pointing",
        "dns entry", "remove a record", "dns setup failed",
    ],
    "domain_visibility": [
        "domain not showing", "site not visible", "domain not working",
        "wrong page showing", "domain not displaying", "website not showing",
        "domain not loading", "site not loading on domain",
        "domain not connected", "site is not visible",
        "i paid for domain but not work", "domain not live",
        "website not live", "page not showing", "domain not resolving",
        "404 on my domain", "domain not pointed correctly",
        "connected domain but not showing",
    ],
    "email_setup": [
        "cannot send email", "cannot receive email", "can't send email",
        "can't receive email", "email not working", "email setup failed",
        "sending mail failing", "receiving mail failing",
        "email not delivering", "email bouncing", "smtp issue",
        "imap issue", "email configuration", "setup email",
        "professional email not working", "workspace email issue",
        "email account not set up", "microsoft 365 email",
        "email forwarding not working",
    ],
    "auto_renewal": [
        "auto renew", "auto-renewal", "domain renewal charge",
        "unexpected renewal", "refund renewal", "renewal charge",
        "auto renewed without permission", "auto renew was off",
        "charged for renewal", "renewal surprise",
        "didn't want to renew domain", "auto renewal disabled but charged",
        "renewal refund", "cancel renewal",
    ],
    "account_blocked": [
        "account locked", "account blocked", "blocked from using",
        "locked method", "account suspended", "access denied",
        "can't log in to account", "login blocked",
        "account disabled", "restricted account",
        "temporarily locked", "account flagged",
    ],
    "otp_auth_failure": [
        "otp issue", "otp not received", "code not received",
        "didn't receive code", "verification code not received",
        "authenticator not working", "sms code issue",
        "two factor issue", "2fa not working", "authentication failed",
        "can't get verification code", "code expired",
        "backup code not working", "authenticator app issue",
        "not receiving sms", "phone verification failed",
    ],
    "delegate_access": [
        "delegate access", "delegate page", "delegate access not working",
        "can't access delegate page", "delegate access denied",
        "delegation issue", "account delegation",
        "delegate login", "manage delegate",
    ],
    "wordpress_builder": [
        "wordpress", "wordpress media upload", "media upload failing",
        "wordpress installation", "install wordpress",
        "wordpress error", "airo website", "airo builder",
        "website builder error", "builder not working",
        "managed wordpress", "wp admin issue",
        "wordpress plugin", "wp site not loading",
        "website builder issue", "drag and drop not working",
    ],
    "ssl_certificate": [
        "ssl not working", "ssl certificate", "https not working",
        "certificate expired", "ssl error", "not secure",
        "certificate issue", "ssl installation failed",
        "mixed content", "ssl renewal", "https redirect not working",
    ],
    "domain_transfer": [
        "transfer domain", "domain transfer failed",
        "transfer out", "transfer in", "domain locked for transfer",
        "transfer authorization", "epp code", "auth code",
        "transfer rejected", "domain not transferred",
        "transfer pending", "unlock domain for transfer",
    ],
}
REVIEW_DICTIONARY = {
    "very_negative": REVIEW_GROUPS["very_negative"],
    "moderate_negative": REVIEW_GROUPS["moderate_negative"],
    "negative_phrases": REVIEW_GROUPS["negative_phrases"],
    "account_merge": [
        "merge account", "merge accounts", "duplicate account",
        "account consolidation", "account i mistakenly created",
        "two accounts", "combine accounts", "link accounts",
        "separate accounts", "merge my profile",
    ],
    "room_promise_violation": [
        "connecting rooms not available", "room not available",
        "promised room not honored", "confirmed room type unavailable",
        "room was not ready", "wrong room type", "room downgrade",
        "booked confirmed", "reservation not honored",
        "room change without notice", "different room than booked",
        "not the room i reserved", "suite not available",
    ],
    "loyalty_pricing": [
        "member cost more than online", "loyalty price higher",
        "rewards member more expensive", "member rate not applied",
        "honors price wrong", "{brand} honors discount not applied",
        "points not credited", "points missing", "points not added",
        "status not recognized", "rewards not applied",
        "member rate not honored", "discount not applied",
    ],
    "partial_cancellation": [
        "partial cancellation", "cancel one night", "remove one night",
        "cancel specific night", "cancel the fourth night",
        "entire booking cancelled", "full booking cancelled when",
        "just wanted to remove", "cancel second night",
        "modify booking", "shorten stay", "reduce nights",
    ],
    "language_barrier": [
        "language barrier", "hard to understand", "couldn't understand",
        "not us based", "offshore support", "communication difficulty",
        "accent issue", "language issue", "couldn't follow",
        "repeat multiple times", "had to repeat myself",
        "did not understand", "basic question not understood",
    ],
    "sales_tactics": [
        "sales pitch", "bait and switch", "bait-and-switch",
        "pushy promotion", "unwanted upsell", "pushy sales",
        "tried to sell me", "felt pressured", "promotional pitch",
        "just a sales call", "upsell attempt", "cross sell",
        "aggressive promotion", "forced to listen to promotion",
    ],
}
