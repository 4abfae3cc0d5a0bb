"""Operations for building training corpora: one module per operator, each DataFrame in, DataFrame out."""
