"""Training-data operators: packing, quality, de-duplication, token files, toxicity, licences, decontamination."""
