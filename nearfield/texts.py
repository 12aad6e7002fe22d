"""What callers are told."""

# Messages of errors that callers match on.
NULL_VECTOR = "Input must be a vector, found NULL"
ZERO_LENGTH = "zero-length vectors are not supported."
NO_BRACKET = "JSON array parsing error: Input does not start with '['"
BAD_NUMBER = "JSON parsing error: not a finite number"
INT8_RANGE = "value out of range for int8"
BLOB_LENGTH = "invalid float32 vector BLOB length. Must be divisible by 4, found {}"
NOT_FINITE = "float32 vector holds NaN or infinity"
DIMENSIONS = "Vector dimension mismatch: first has %d dimensions, second has %d dimensions."
BIT_ARITHMETIC = "Cannot add or subtract two bit vectors together."
SLICE_POSITIVE = "slice 'start' and 'end' indices must be positive numbers"
SLICE_ORDER = "slice 'start' index is greater than 'end' index"
SLICE_EMPTY = "slice 'start' index is equal to the 'end' index, vectors must have non-zero length"
SLICE_BITS = "start and end index must be divisible by 8."
SLICE_END = "slice 'end' index is greater than the number of dimensions"
BINARY_LENGTH = "Binary quantization requires vectors with a length divisible by 8"
INT8_KIND = "2nd argument to vec_quantize_int8() must be 'unit'."
K_NEGATIVE = "k value in knn queries must be greater than or equal to 0."
K_LARGE = "k value in knn query too large, provided {} and the limit is {}"
UNIQUE = "UNIQUE constraint failed on {} primary key"
DIMENSION_OF_COLUMN = "Dimension mismatch for column {}: expected {}, found "
