"""Result-parity evaluation on Spark.

Many cases, each with an expected and a produced result table, are brought into one canonical
form, compared by deterministic rules, and summarised in a fixed number of Spark jobs.
"""
