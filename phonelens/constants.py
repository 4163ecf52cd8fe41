"""Values that must equal the source's for the same results.

Fixed values (from the source, in its order):
- call types: 1 = caller row, 2 = called row
- short call: under 5 seconds
- first flow: 5 stratified folds, shuffle seed 1024; boosting with depth 6,
  50 bins, learning rate 0.02, 0.8 of columns, 0.8 of rows, 25 rows per
  leaf, 1000 rounds, seed 1000
- boosting stops when the validation loss has not fallen for 200 rounds
- cut-off search: 600 percentiles, 32 + 0.08 * i, cut rounded to 4 digits,
  ties keep the last
- second flow: 3 stratified folds, shuffle seed 2020; boosting with 2000
  rounds, learning rate 0.05; output = mean score - 0.3
- hold-out split: 0.3 of rows, seed 2020
- segment bounds of the source: fewer than 2 app months, more than 100
  contacts, more than 10 handsets, handsets with more than 1 phone
"""

CALLER = 1
CALLED = 2
SHORT_CALL_SECONDS = 5.0

FIRST_FOLDS = 5
FIRST_SEED = 1024
FIRST_DEPTH = 6
FIRST_BINS = 50
FIRST_RATE = 0.02
FIRST_COLUMNS = 0.8
FIRST_ROWS = 0.8
FIRST_MIN_LEAF = 25
FIRST_ROUNDS = 1000
FIRST_TREE_SEED = 1000

CUT_POINTS = 600
CUT_START = 32.0
CUT_STEP = 0.08
CUT_DIGITS = 4

PATIENCE = 200

SECOND_FOLDS = 3
SECOND_SEED = 2020
SECOND_ROUNDS = 2000
SECOND_RATE = 0.05
SECOND_OFFSET = 0.3

HOLDOUT_FRACTION = 0.3
HOLDOUT_SEED = 2020

LOW_USAGE_MONTHS = 2
SOURCE_CONTACTS_OVER = 100
SOURCE_HANDSETS_OVER = 10
SHARED_HANDSET_PHONES_OVER = 1

# Not from the source: bounds that split the shared test tables (FIXTURES.md)
FIXTURE_CONTACTS_OVER = 40
FIXTURE_LOW_MONTHS = 8
FIXTURE_HANDSETS_OVER = 40
