"""Word lists, bins and patterns with fixed values."""

# Results depend on these exact words.
KEYWORD_STEMS = (
    "depress", "depressed", "depression", "anxious", "anxiety", "panic", "hopeless", "worthless", "useless", "empty", "numb", "exhausted", "tired",
    "alone", "lonely", "isolat", "isolated", "suicide", "suicidal", "kill", "die", "death", "dead", "hurt", "hate", "broken", "lost", "pain", "crying",
    "tears", "therapy", "therapist", "medication", "meds", "pills", "trauma", "abuse", "abused", "ptsd",
)
SAMPLE_KEYWORD_STEMS = (
    "depress", "depressed", "depression", "anxious", "anxiety", "hopeless", "worthless", "useless", "empty", "numb", "suicide", "suicidal", "kill", "die",
    "death", "therapy", "therapist", "medication", "meds", "pills",
)
FIRST_PERSON = (
    "i", "me", "my", "mine", "myself", "im",
)
SECOND_PERSON = (
    "you", "your", "youre", "yours", "yourself", "yourselves", "u", "ur",
)
ABSOLUTIST = (
    "absolutely", "all", "always", "complete", "completely", "constant", "constantly", "definitely", "entire", "entirely", "ever", "every", "everyone",
    "everything", "full", "fully", "must", "never", "nothing", "none", "nobody", "nowhere", "totally", "total", "whole",
)
NEGATION = (
    "no", "not", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "cant", "cannot", "wont", "dont", "doesnt", "didnt", "isnt", "arent",
    "wasnt", "werent", "hasnt", "havent", "hadnt", "shouldnt", "wouldnt", "couldnt",
)
NEGATIVE_AFFECT = (
    "sad", "angry", "afraid", "scared", "fear", "lonely", "miserable", "horrible", "terrible", "awful", "bad", "worse", "worst", "hopeless", "helpless",
    "useless", "worthless", "stupid", "ugly", "fail", "failed", "failure", "wrong", "mistake", "regret", "sorry", "guilty", "shame", "ashamed", "hate",
)
ENGLISH_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "than", "too", "very", "s", "t", "just",
    "now", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "doing", "would", "should", "could", "ought",
    "it", "its", "this", "that", "these", "those", "they", "them", "their", "we", "us", "our", "you", "your", "he", "she", "his", "her", "him", "as",
    "so", "also", "like", "get", "got", "really", "much", "even", "still", "back", "way", "go", "going", "want", "know", "think", "make", "made", "see",
    "say", "said", "thing", "things", "people", "time", "one", "two", "lot", "well", "yeah", "ok", "okay",
)
COMMON_ENGLISH = (
    "the", "and", "to", "of", "a", "is", "in", "that", "it", "for", "i", "you", "my", "with", "this", "have", "be", "on", "are",
)
REMOVED_MARKS = ("[removed]", "[deleted]", "removed", "deleted", "", "nan", "none", "null")
LENGTH_EDGES = (0, 50, 200, 500, 1000, 2000, 5000)
GROUP_SIZE_EDGES = (0, 10, 50, 100, 500, 1000, 5000, 10000, 100000, 10000000)
AUTHOR_TITLE_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "threads.net", "threads.com", "tiktok.com")
NEUTRAL = {"title_len_chars": 38.0, "body_to_title_ratio": 2.96, "upvotes_log": 2.08, "num_comments_log": 1.95, "comments_per_upvote": 0.64}
TIME_RANGE = (1104537600, 1893456000)  # 2005-01-01 to 2030-01-01 UTC, in seconds
