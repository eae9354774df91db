"""DataFrame operators grouped by the stage of the text pipeline they serve.

rank      exact ranks, cut-offs and running sums (bucketed prefix sums)
prepare   projections, recoding, frequency filters, quotas, samples, splits
text      prompts, tokenising and padding, vocabulary, encode/decode, parsing
windows   strided windows, corpus offsets and windows, packing
vectors   mean vectors, softmax at a temperature, distillation losses
privacy   clipping, noisy aggregates, noise calibration, bounding, ledger
model     DP n-gram tables, smoothing, mixtures, candidates
generate  label-conditioned generation
evaluate  token NLL and window perplexities
udf       batched pandas map
"""
