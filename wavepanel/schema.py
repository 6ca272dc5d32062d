"""Column names of the tidy tables (long, periods, panel)."""

FAMILY = "family"
TERRITORY = "territory"
TIME = "time"            # wave number (int) in long/periods; 'FIRST'/'LAST' in panel
WAVE = "wave"            # panel keeps the wave number under this name
QUESTION = "question"
ANSWER = "answer"
COLUMN = "column"
ORIGINAL_COLUMN = "original_column"
TIME_FIRST = "time_first"
TIME_LAST = "time_last"

FIRST = "FIRST"
LAST = "LAST"
