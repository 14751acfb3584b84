"""Word lists and sentence formats of case reports and verdicts."""

# Tokens that mark a failure. Whole words of a template for the root cause; substrings for the keyword rule.
ROOT_CAUSE_TOKENS = ["exception", "error", "failed", "failure", "timeout", "denied"]
KEYWORD_TOKENS = ["exception", "error", "failed", "failure", "timeout", "denied", "interrupted", "abort"]

# Causes a narrative may name only if the case's templates do.
CAUSE_TERMS = [
    "disk", "hardware", "memory", "ram", "cpu", "swap", "oom", "network", "congestion", "bandwidth", "latency", "packet", "firewall", "dns", "connectivity", "corrupt", "corruption",
    "config", "configuration", "misconfiguration", "misconfigured", "permission", "credential", "security", "attack", "malicious", "intrusion", "overload", "outage", "power",
    "temperature", "throttle", "capacity", "quota", "throughput", "bottleneck", "storage", "infrastructure", "failure", "software", "resource", "performance",
]
CAUSE_PHRASES = ["software bug", "resource constraint", "resource issue", "performance issue", "configuration error", "data management", "service outage", "system failure"]

# Phrases that drop a sentence: verdicts, speculation and, where the prediction was right, deviations.
VERDICT_PHRASES = ["prediction correct", "confidence score", "anomaly score", "classification", "expected event", "observed event", "workflow transition", "expected next event", "observed next event"]
SPECULATION_PHRASES = ["suggests", "indicates", "implies", "may indicate", "could indicate", "likely", "possibly", "potentially", "appears to", "seems to"]
CONTRADICTION_PHRASES = [
    "deviation", "deviates", "deviated", "different event", "differs from", "instead of", "unexpected event", "unexpected transition", "does not match", "doesn't match", "did not match", "didn't match", "mismatch",
    "anomalous transition", "out of order", "out-of-order", "wrong event",
]

# Security terms whose unsupported use counts as invented.
SECURITY_TERMS = [
    "malware", "ransomware", "spyware", "trojan", "virus", "worm",
    "insider", "threat", "cyberattack", "cyber-attack", "cyber attack", "breach", "exploit", "phishing", "ddos", "espionage", "hacker", "hacking", "backdoor", "rootkit", "exfiltration", "compromise", "adversary",
]

# Sentences of the report.
NO_ROOT_CAUSE = "The sequence does not provide enough evidence to determine a root cause."
INSUFFICIENT = "There is insufficient evidence in the provided logs to determine the root cause."
ROOT_CAUSE = 'The observed event template contains "%s". The sequence does not provide enough evidence to determine a deeper root cause.'
MATCH_FALLBACK = "The predicted and actual events match; no workflow deviation was detected. The case was flagged by low model certainty."
CONFIDENCE_TEXTS = {
    "ANOMALY": "The model had very low confidence in this prediction (%s), so the case was automatically flagged as a likely anomaly for review.",
    "NORMAL": "The model was confident in this prediction (%s), so the case looks like normal activity.",
    "OTHER": "The model is uncertain about this prediction (%s) and therefore routed this case for additional review.",
}

# Formats of the deviation, interpretation and steps; %s stands for events and quoted templates.
DEVIATION_SAME = "No workflow deviation was detected. The observed next event %s matches the model's top prediction, so the event order did not change. This case was flagged by the detector's low certainty, not by any change in the sequence of events"
RECORDED = '. Recorded operation: "%s".'
DEVIATION_OTHER = "The model expected %s%s, but the sequence continued with %s%s. In workflow terms this is the %s -> %s transition. %s"
DEVIATION_TAIL = "The templates show what each step records; they do not by themselves state why the order changed."
INTERPRETATION_SAME = "The observed event %s%s is the model's own top prediction, so the logged step matches expectation. This case was flagged because the model's certainty was low, even though the predicted and actual events are the same."
INTERPRETATION_OTHER = "The expected step was %s%s, but the sequence recorded %s%s instead — a deviation at the %s -> %s transition.%s"
STEP_LINES = "Review the raw HDFS log lines matching the observed event %s%s"
STEP_CORRECT = "Confirm why the anomaly score is elevated even though the predicted and actual events both equal %s."
STEP_WRONG = "Compare against the expected event %s%s Confirm whether the %s -> %s transition is valid for this block."
STEP_TRAFFIC = "Verify whether this exact event sequence has occurred in known-normal traffic for the same BlockId."

# The observed pattern and the whole report.
NO_TEMPLATE = "template unavailable"
PATTERN_EVENT = "%s (%s)"
PATTERN_SHORT = "The sequence is %s."
PATTERN_LONG = "The sequence is %d events ending in %s."
PATTERN_BARE = "The sequence is %d events: %s. No log templates were supplied for these EventIds."
PATTERN_EMPTY = "The observed window contains no events."
REPORT_FOCUS = """Model Attention Focus
  (input events the model weighted most when predicting the next event)
%s

"""
REPORT = """Summary
  Observed Sequence Pattern: %s

Prediction
  Expected Event    : %s — %s
  Observed Event    : %s — %s
  Prediction Correct: %s

Deviation Analysis
  %s

Confidence
  Confidence Score  : %s
  Anomaly Score     : %s
  Classification    : %s
  Interpretation    : %s

Evidence-Based Interpretation
  %s

%sRoot Cause Assessment
  %s

Recommended Investigation
%s"""

# Lines of the facts message.
FACT_SEQUENCE = "Observed sequence (%d events, in order):"
FACT_EXPECTED = "Expected next event : %s -> %s"
FACT_ACTUAL = "Actual next event   : %s -> %s"
FACT_SCORE = "Anomaly score (0-1, higher = more surprising) : %.2f"
FACT_CONFIDENCE = "Confidence score (0-1, model's prob of the actual event) : %.2f"
FACT_PERCENTILE = "Block surprise percentile among NORMAL validation blocks : %.1f (100 = more surprising than every normal block)"
FACT_ACTUAL_FREQUENCY = "Actual event %s in NORMAL training data : %s among %,d events"
FACT_EXPECTED_FREQUENCY = "Expected event %s in NORMAL training data : seen %,d times"
FACT_WINDOW = "Surprising transition #%d in this block : actual %s -> %s (surprise %.2f)"
FACT_REASON = "GRU detector was not confident (UNCERTAIN band)."
FACT_QUESTION = "Give the FINAL classification (NORMAL or SUSPICIOUS) for this case using ONLY the facts above."
