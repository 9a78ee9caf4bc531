"""Click-model training on Spark DataFrames.

Impression logs in, feature dictionary, weighted binary examples, L2-regularised
logistic regression by distributed conjugate gradient, accuracy and ROC AUC out.
"""
